"""Entity resolution: which application an incoming message answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import vocabulary as V
from ..session import cut
from .joins import best_by_time, contains_join

LEAST_SLUG, LEAST_COMPANY, BODY_HEAD = 4, 3, 800
STRATEGIES = ("thread", "domain", "display-name", "subject", "body")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_generic_sender(domain: Column | str) -> Column:
    """Whether a domain names a platform and not an employer."""
    return U.under(_c(domain), V.GENERIC_DOMAINS) | T.registrable_domain(domain).isin(*V.BOARD_LABELS)


def is_board_sender(sender: Column | str) -> Column:
    """Whether the sender (a From header) is a job board that mails alerts."""
    domain = T.sender_domain(sender)
    board = T.registrable_domain(domain).isin(*V.BOARD_LABELS) | U.under(domain, V.BOARD_DOMAINS)
    return ~T.sender_mailbox(sender).isin(*V.BOARD_EXCEPTIONS) & board


def is_company_domain(company: Column | str, domain: Column | str) -> Column:
    """Whether the slug of one begins with that of the other, both of 4 letters or more."""
    a, b = T.company_slug(T.fold(company)), T.slug(T.fold(T.registrable_domain(domain)))
    return (F.length(a) >= LEAST_SLUG) & (F.length(b) >= LEAST_SLUG) & (b.startswith(a) | a.startswith(b))


def ends(found: Column) -> Column:
    """Where each word begins, and the last ends, when the words are run together."""
    return F.aggregate(found, F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + F.length(w)))


def names_in(found: Column, want: Column) -> Column:
    """Whether the words of a text name the words of a company: all of them occur, or some run
    of words of the text, however many, joins to exactly the company's words joined."""

    def test(f: Column, w: Column) -> Column:
        slug, whole, at = F.array_join(w, ""), F.array_join(f, ""), ends(f)
        run = lambda e, x, y: F.exists(e, lambda i: (F.substring(x, i + 1, F.length(y)) == y) & F.array_contains(e, i + F.length(y)))
        bound = F.array(F.struct(at.alias("e"), whole.alias("x"), slug.alias("y")))
        runs = F.get(F.transform(bound, lambda s: run(s["e"], s["x"], s["y"])), F.lit(0))
        return F.when((F.length(slug) < LEAST_COMPANY) | (F.size(f) == 0), F.lit(False)).when(F.size(F.array_except(w, f)) == 0, F.lit(True)).otherwise(runs)

    # words are made once, not at each place
    bound = F.array(F.struct(found.alias("f"), want.alias("w")))
    return F.get(F.transform(bound, lambda s: test(s["f"], s["w"])), F.lit(0))


def names_company(text: Column | str, company: Column | str) -> Column:
    return names_in(T.words(T.fold(text)), T.company_words(T.fold(company)))


def _one_employer(wa: Column, wb: Column, sa: Column, sb: Column, ia: Column, ib: Column) -> Column:
    """The same of the words, slugs and initials of two names."""
    within = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    short = lambda s, i: (F.length(s) >= 3) & (s == i)
    return (F.size(wa) > 0) & (F.size(wb) > 0) & (within | ((F.length(sa) >= 3) & (sa == sb)) | short(sa, ib) | short(sb, ia))


def same_company(a: Column | str, b: Column | str) -> Column:
    """Whether two names may be one employer: words of one within the other, the same slug, or
    the initials of the other."""
    (wa, sa, ia), (wb, sb, ib) = ((T.company_words(T.fold(x)), T.company_slug(T.fold(x)), T.initials(T.fold(x))) for x in (a, b))
    return _one_employer(wa, wb, sa, sb, ia, ib)


def employers(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct pairs of names (columns ``rc`` of ``left``, ``ac`` of ``right``) that may be one employer.

    Where the words of one are within the other, the rarest of them is a word of both; the
    other ways are equal slugs, and a slug that equals initials. So each name has its rarest
    word and its slug for keys, and no word that many names share. What names are made of is
    written once: inlined into each way to meet, the folds are a plan that fills the driver.
    """
    names = lambda df, c: df.select(c).distinct().filter(F.col(c).isNotNull()).withColumn("f", T.fold(c))
    made = lambda df, c: cut(names(df, c).select(c, T.company_words("f").alias("w"), T.company_slug("f").alias("s"), T.initials("f").alias("i")))
    a, b = made(left, "rc"), made(right, "ac")
    words = lambda df, c: df.select(c, F.explode(F.array_distinct("w")).alias("k"))
    often = words(a, "rc").select("k").unionByName(words(b, "ac").select("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rarest = lambda df, c: words(df, c).join(often, "k").groupBy(c).agg(F.min(F.struct("n", "k"))["k"].alias("k"))
    key = lambda df, c, k: df.select(c, F.col(k).alias("k")).filter("length(k) >= 3")
    ways = [
        (rarest(a, "rc"), words(b, "ac")),
        (words(a, "rc"), rarest(b, "ac")),
        (key(a, "rc", "s"), key(b, "ac", "s")),
        (key(a, "rc", "s"), key(b, "ac", "i")),
        (key(a, "rc", "i"), key(b, "ac", "s")),
    ]
    found = None
    for x, y in ways:
        both = x.join(y, "k").select("rc", "ac")
        found = both if found is None else found.unionByName(both)
    of = lambda df, c, x: df.select(c, *[F.col(k).alias(k + x) for k in ("w", "s", "i")])
    both = found.distinct().join(of(a, "rc", "a"), "rc").join(of(b, "ac", "b"), "ac")
    return both.filter(_one_employer(*[F.col(k) for k in ("wa", "wb", "sa", "sb", "ia", "ib")])).select("rc", "ac")


def companies_of(applications: DataFrame) -> DataFrame:
    """``words, slug, n_companies, company, n_apps, app_id`` for each distinct list of identifying words.

    ``applications``: app_id, app_company. A company is a name in lower case without blanks at
    its ends; several may have the same words. ``company`` is one of them (which matters only
    where n_companies is 1), ``app_id`` the largest id.
    """
    name = F.lower(T.strip("app_company"))
    each = applications.filter("app_company IS NOT NULL").groupBy(name.alias("company")).agg(F.count_distinct("app_id").alias("n_apps"), F.max("app_id").alias("app_id"), F.max("app_company").alias("_c"))
    each = each.withColumn("words", T.company_words(T.fold("_c")))
    got = each.groupBy("words").agg(F.count(F.lit(1)).alias("n_companies"), F.max("company").alias("company"), F.sum("n_apps").alias("n_apps"), F.max("app_id").alias("app_id"))
    return got.withColumn("slug", F.array_join("words", ""))


def named_in(texts: DataFrame, companies: DataFrame) -> DataFrame:
    """``texts`` (found: words, and other columns, which are returned) with the companies of ``companies_of``
    that each names; each row once.

    A company has two keys: the rarest of its words, counted over all companies, and its slug.
    A text has its words, and its runs of words of a length that some slug has. So a word that
    many names share is nobody's key. A key of a text moves with the text's number alone; only what
    meets a company meets the text's words again. Texts of the same words are searched once.
    """
    able = companies.filter(F.length("slug") >= LEAST_COMPANY)
    word = able.select("words", F.explode(F.array_distinct("words")).alias("_w"))
    often = word.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    rarest = word.join(often, "_w").groupBy("words").agg(F.min(F.struct("_n", "_w"))["_w"].alias("_rarest"))
    keys = F.array(F.struct(F.col("_rarest").alias("k"), F.lit(False).alias("run")), F.struct(F.col("slug").alias("k"), F.lit(True).alias("run")))
    keyed = able.join(rarest, "words").withColumn("_x", F.explode(keys)).select(*able.columns, F.col("_x.k").alias("_key"), F.col("_x.run").alias("_run"))
    # one row; as many entries as names differ in length
    lengths = able.agg(F.collect_set(F.length("slug")).alias("_lengths"))
    told = texts.withColumn("_no", F.xxhash64("found"))
    apart = told.groupBy("_no").agg(F.first("found").alias("found"))
    at = apart.crossJoin(F.broadcast(lengths)).withColumn("_whole", F.array_join("found", "")).withColumn("_ends", ends(F.col("found")))
    runs = F.flatten(F.transform("_ends", lambda i: F.transform(F.filter("_lengths", lambda n: F.array_contains("_ends", i + n)), lambda n: F.struct(F.substring(F.col("_whole"), i + 1, n).alias("k"), F.lit(True).alias("run")))))
    said = F.transform(F.array_distinct("found"), lambda w: F.struct(w.alias("k"), F.lit(False).alias("run")))
    # outer: of a plain one the planner makes a filter of the whole expression, inlined down to the text; nulls meet nothing
    each = at.withColumn("_x", F.explode_outer(F.array_distinct(F.concat(said, runs)))).select("_no", F.col("_x.k").alias("_key"), F.col("_x.run").alias("_run"))
    met = each.join(keyed, ["_key", "_run"]).drop("_key").join(apart, "_no")
    got = met.filter(F.col("_run") | (F.size(F.array_except("words", "found")) == 0)).drop("_run", "found").distinct()
    return told.drop("found").distinct().join(got, "_no").drop("_no")


def of_domain(senders: DataFrame, companies: DataFrame) -> DataFrame:
    """``senders`` (label, and other columns) with the companies whose slug begins with the label or the
    label with it, both of 4 letters or more.

    By equality: of the label's beginnings, of the lengths that slugs have, with slugs, and of
    the label with the slugs' beginnings, which are counted first, so that a beginning that many
    share is one row.
    """
    cols = senders.columns
    able = companies.filter(F.length("slug") >= LEAST_SLUG)
    merged = lambda df, key: df.groupBy(key).agg(F.sum("n_companies").alias("n_companies"), F.max("company").alias("company"), F.sum("n_apps").alias("n_apps"), F.max("app_id").alias("app_id"))
    long = senders.filter(F.length("label") >= LEAST_SLUG)
    lengths = able.agg(F.collect_set(F.length("slug")).alias("_lengths"))
    own = F.filter("_lengths", lambda n: n < F.length("label"))
    below = long.crossJoin(F.broadcast(lengths)).withColumn("_key", F.explode(F.transform(own, lambda n: F.substring(F.col("label"), F.lit(1), n)))).select(*cols, "_key")
    below = below.join(merged(able, "slug"), F.col("_key") == F.col("slug")).drop("_key", "slug")
    sizes = long.agg(F.collect_set(F.length("label")).alias("_sizes"))
    heads = able.crossJoin(F.broadcast(sizes)).withColumn("_key", F.explode(F.transform(F.filter("_sizes", lambda n: n <= F.length("slug")), lambda n: F.substring(F.col("slug"), F.lit(1), n))))
    above = long.join(merged(heads, "_key"), F.col("label") == F.col("_key")).drop("_key")
    return below.unionByName(above)


def match_replies(messages: DataFrame, applications: DataFrame) -> DataFrame:
    """``message_id, application_id, strategy, conclusive`` for the messages that match.

    ``messages``: message_id, thread_id, from_address, subject, body, received_at;
    ``applications``: id, company, thread_id, sent_at. Strategies in order: the thread; then,
    unless the sender is a board, the sender's domain, its display name, the subject, the
    first 800 characters of the body. The first that resolves wins: its candidates are of one
    company (folded); of several applications the best by send time is taken and isn't
    conclusive; the body never is.

    Texts are matched with companies, not with applications, and by equality alone (see
    ``of_domain`` and ``named_in``); only what resolves to one company meets its applications.
    """
    apps = applications.select(F.col("id").alias("app_id"), F.col("company").alias("app_company"), F.col("thread_id").alias("app_thread"), F.col("sent_at").alias("app_sent"))
    # every way to meet a company reads them, so they are worked out once
    companies = cut(companies_of(apps))
    m = messages.select("message_id", "thread_id", "from_address", "subject", F.substring("body", 1, BODY_HEAD).alias("head"), "received_at")
    m = m.withColumn("domain", T.sender_domain("from_address")).withColumn("board", is_board_sender("from_address"))

    threaded = m.filter("thread_id IS NOT NULL AND thread_id <> ''").join(apps, F.col("thread_id") == F.col("app_thread"))
    by_thread = threaded.groupBy("message_id").agg(F.min("app_id").alias("application_id"))
    by_thread = by_thread.select("message_id", "application_id", F.lit("thread").alias("strategy"), F.lit(True).alias("conclusive"), F.lit(0).alias("_order"))

    rest = m.filter(~F.col("board"))
    cols = ["message_id", "_order", "n_companies", "company", "n_apps"]
    label = T.slug(T.fold(T.registrable_domain("domain")))
    d = rest.filter((F.col("domain") != "") & ~is_generic_sender("domain")).select("message_id", label.alias("label"), F.lit(1).alias("_order"))
    domain = of_domain(d, companies).select(*cols)

    texts = rest.select("message_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), t.alias("t")) for k, t in ((2, T.display_name("from_address")), (3, F.coalesce("subject", F.lit(""))), (4, F.coalesce("head", F.lit(""))))])).alias("x"))
    texts = texts.select("message_id", F.col("x.k").alias("_order"), T.words(T.fold("x.t")).alias("found")).filter(F.size("found") > 0)
    named = named_in(texts, companies).select(*cols)

    sizes = domain.unionByName(named).groupBy("message_id", "_order").agg(F.sum("n_companies").alias("_companies"), F.max("company").alias("company"), F.sum("n_apps").alias("_apps"))
    clear = sizes.filter("_companies = 1").groupBy("message_id").agg(F.min(F.struct("_order", "_apps", "company")).alias("_b")).select("message_id", "_b.*")
    with_apps = clear.join(m.select("message_id", "received_at"), "message_id").join(apps.withColumn("company", F.lower(T.strip("app_company"))), "company")
    won = best_by_time(with_apps, ["message_id"], "app_sent", "received_at", "app_id")
    strategy = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("_order") + 1)
    won = won.select("message_id", F.col("app_id").alias("application_id"), strategy.alias("strategy"), ((F.col("_apps") == 1) & (F.col("_order") < 4)).alias("conclusive"), "_order")
    best = Window.partitionBy("message_id").orderBy("_order")
    return by_thread.unionByName(won).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_order")


def similar_classes(replies: DataFrame, applications: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``similar_applications`` finds, without a row for each reply and application of an employer:

    ``reply_id, employer, n_named`` for each reply that tells an employer, ``employer, application_id,
    reason`` for the applications that all replies of that name share, and ``reply_id, application_id,
    reason`` for those that a reply finds by its role. The size is that of replies and applications, however
    many of both are of one employer.
    """
    r, named, role = _similar(replies, applications, days)
    of_reply = r.join(named.groupBy("rc").agg(F.count(F.lit(1)).alias("n_named")), "rc", "left").select("reply_id", F.col("rc").alias("employer"), F.coalesce("n_named", F.lit(0)).alias("n_named"))
    return of_reply, named.withColumnRenamed("rc", "employer"), role


def _similar(replies: DataFrame, applications: DataFrame, days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The replies that tell an employer (``rc``), ``rc, application_id, reason`` of each name, and what is found by role.

    Names, titles and companies are each folded once and written before they meet, and so are the pairs of
    names and titles: all that is joined twice with the applications, which aren't.
    """
    a = applications.filter("sent_at IS NOT NULL").select(F.col("id").alias("application_id"), F.col("company").alias("ac"), F.col("title").alias("at"), "sent_at")
    r = replies.filter(F.coalesce(T.strip("detected_company"), F.lit("")) != "").select(F.col("id").alias("reply_id"), F.col("detected_company").alias("rc"), F.col("detected_role").alias("rr"), "received_at")
    same = cut(employers(r.select("rc"), a.select("ac"))).withColumn("reason", F.lit("same employer"))
    titles = cut(a.select("at").distinct().withColumn("found", T.words(T.fold("at")))).filter(F.size("found") > 0)
    wanted = cut(r.select("rc").distinct().withColumn("words", T.company_words(T.fold("rc"))))
    companies = cut(companies_of(r.select(F.col("reply_id").alias("app_id"), F.col("rc").alias("app_company"))))
    said = cut(named_in(titles, companies).select("at", "words").join(wanted, "words").select("at", "rc").distinct())
    by_name = same.join(a, "ac").select("rc", "application_id", "reason", F.lit(0).alias("_o"))
    by_title = said.join(a, "at").select("rc", "application_id", F.lit("employer named in the title").alias("reason"), F.lit(1).alias("_o"))
    named = by_name.unionByName(by_title).groupBy("rc", "application_id").agg(F.min_by("reason", "_o").alias("reason"))
    rw = r.withColumn("_w", T.role_words(T.fold("rr"))).filter("size(_w) > 0 AND received_at IS NOT NULL")
    aw = a.withColumn("_w", T.role_words(T.fold("at")))
    width = F.expr(f"INTERVAL {int(days)} DAYS")
    role = rw.join(aw, "_w").filter(F.col("sent_at").between(F.col("received_at") - width, F.col("received_at") + width))
    role = role.groupBy("reply_id", "rc").agg(F.max("application_id").alias("application_id"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    role = role.join(named, ["rc", "application_id"], "left_anti").select("reply_id", "application_id", F.lit("same role, sent the same week").alias("reason"))
    return r, named, role


def similar_applications(replies: DataFrame, applications: DataFrame, days: int = 7) -> DataFrame:
    """``reply_id, application_id, reason``: what a reviewer should see before a new record is made.

    ``replies``: id, detected_company, detected_role, received_at; ``applications``: id, company,
    title, sent_at. By employer, and by role where exactly one application has it and was sent
    within ``days`` of the message. Candidates come from equality (see ``employers``, ``named_in``).
    All pairs are written out, which is for the replies of a page; see ``similar_classes`` for many.
    """
    r, named, role = _similar(replies, applications, days)
    return r.select("reply_id", "rc").join(named, "rc").select("reply_id", "application_id", "reason").unionByName(role)


def sent_threads(applications: DataFrame, mail: DataFrame) -> DataFrame:
    """``id, thread_id`` where exactly one thread of sent mail names the company, from a day before
    to three days after the application was sent. ``mail``: thread_id, to_text, sent_at."""
    a = applications.select("id", F.lower("company").alias("_company"), F.col("sent_at").alias("_s"))
    near = contains_join(mail.withColumn("_to", F.lower("to_text")), a, "_to", "_company").filter(F.col("sent_at").between(F.col("_s") - F.expr("INTERVAL 1 DAY"), F.col("_s") + F.expr("INTERVAL 3 DAYS")))
    return near.groupBy("id").agg(F.when(F.count_distinct("thread_id") == 1, F.max("thread_id")).alias("thread_id")).filter("thread_id IS NOT NULL")


def incoming_in_threads(mail: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages of the threads that came in: without the labels of own mail."""
    own = F.array(*[F.lit(x) for x in ("SENT", "DRAFT", "TRASH")])
    return mail.join(threads.select("thread_id").distinct(), "thread_id", "left_semi").filter(~F.arrays_overlap("labels", own))
