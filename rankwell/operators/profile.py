"""The profile that postings are matched with: texts in a folder, read once on the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import versions
from ..functions import text as T
from ..functions.vectors import Encoder

SHARED, STYLE = "shared.md", "writing_style.md"


def _text(spark: SparkSession, path: str) -> str | None:
    """The whole text of a file, without white space at its ends; null if there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return "".join(r.value for r in rows).strip()


def load_profile(spark: SparkSession, folder: str, name: str, shared: str = SHARED) -> str:
    """The header of the profile, then the block that all profiles share, if there is one."""
    header = _text(spark, f"{folder}/{name}.md")
    if header is None:
        raise FileNotFoundError(f"no profile {name} in {folder}")
    return "\n\n".join(x for x in (header, _text(spark, f"{folder}/{shared}")) if x is not None).strip()


def load_style(spark: SparkSession, folder: str, name: str = STYLE) -> str:
    """A sample of writing; empty if there is none."""
    return _text(spark, f"{folder}/{name}") or ""


def load_constraints(spark: SparkSession, profile: str) -> str:
    """The lines of a profile that say where its owner lives and may work."""
    return spark.range(1).select(F.array_join(T.key_value_lines(F.lit(profile)), "\n").alias("x")).first().x


#: Vectors of this process, by what made them.
_VECTORS: dict[str, list[float]] = {}


def profile_vector(spark: SparkSession, profile: str, encoder: Callable[[], Encoder], model: str = "", folder: str | None = None) -> list[float]:
    """The profile's vector. It is made once for each text and ``model`` (the encoder's name; without one nothing
    is remembered), and with a ``folder`` once for all runs: the next one reads it and loads no model."""
    key = hashlib.sha256(f"{model}\0{profile}".encode()).hexdigest() if model else None
    if key in _VECTORS:
        return _VECTORS[key]
    path = f"{folder}/{key}.json" if folder and key else None
    kept = _text(spark, path) if path else None
    if kept is not None:
        vector = json.loads(kept)
    else:
        encode = encoder()
        try:
            vector = [float(x) for x in encode([profile])[0]]
        finally:
            getattr(encode, "close", lambda: None)()
        if path:
            try:
                versions.put(spark, path, json.dumps(vector))
            except versions.Conflict:
                pass  # another run has made the same
    if key:
        _VECTORS[key] = vector
    return vector
