"""Word lists, hosts and patterns that results depend on.

They have to be exactly these for the same records to pass, match and merge; nothing here
is logic. Java patterns are read with the flags (?iU) unless a function says otherwise.
"""

# Query parameters that don't belong to a URL's identity (and all that begin with utm_).
VOLATILE_PARAMS = ("se", "ref", "referer", "referrer", "src", "gclid", "fbclid", "msclkid", "trk", "mc_cid")

# Letters that have no decomposition, and what they fold to.
TRANSLITERATE = (("ł", "l"), ("đ", "d"), ("ø", "o"), ("ħ", "h"), ("ı", "i"), ("þ", "th"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"))

# Words of company names that identify nobody.
COMPANY_NOISE = (
    "inc", "llc", "ltd", "limited", "gmbh", "bv", "nv", "ab", "oy", "as", "sa", "srl", "spa", "plc", "co", "corp",
    "corporation", "company", "group", "holding", "holdings", "technologies", "technology", "tech", "labs", "lab",
    "software", "solutions", "systems", "digital", "studio", "studios", "games", "the", "sp", "spzoo", "zoo", "oo",
    "ooo", "z", "o", "spolka", "fundacja", "doo", "dooel", "sro", "kft", "ag", "kg", "oyj", "aps", "asa",
)

# Labels at the end of a domain that aren't its name.
SUFFIXES = (
    "com", "net", "org", "edu", "gov", "biz", "info", "io", "co", "ai", "dev", "app", "me", "xyz", "tech", "jobs",
    "eu", "uk", "us", "ru", "de", "fr", "nl", "se", "no", "fi", "dk", "pl", "cz", "es", "it", "pt", "ch", "at", "be",
    "ie", "ca", "au", "nz", "br", "jp", "cn", "in", "sg", "il", "ge", "rs", "ua", "by", "kz", "tr", "gr", "hu", "ro",
    "bg", "hr", "si",
)

# Sender domains that name a platform, not an employer.
GENERIC_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "yahoo.com", "yandex.ru", "mail.ru", "proton.me",
    "protonmail.com", "greenhouse.io", "greenhouse-mail.io", "lever.co", "hire.lever.co", "ashbyhq.com",
    "myworkday.com", "workablemail.com", "workable.com", "smartrecruiters.com", "bamboohr.com", "recruitee.com",
    "teamtailor.com", "personio.de", "jobvite.com", "icims.com", "taleo.net", "successfactors.com", "linkedin.com",
    "indeed.com", "glassdoor.com", "wellfound.com", "hh.ru", "habr.com", "landing.jobs",
)

# Boards by label and by domain, and mailboxes on board domains that do answer.
BOARD_LABELS = ("adzuna", "arbeitnow", "avito", "djinni", "getmatch", "justjoin", "nofluffjobs", "pracuj", "remoteok", "remotive", "totaljobs", "totaljobsmail")
BOARD_DOMAINS = ("linkedin.com", "indeed.com", "glassdoor.com", "wellfound.com", "hh.ru", "habr.com", "career.habr.com", "landing.jobs", "reed.co.uk")
BOARD_EXCEPTIONS = ("noreply@career.habr.com", "noreply@aplikacje.pracuj.pl")

# Words of a role title that don't tell roles apart.
ROLE_NOISE = ("m", "f", "d", "w", "x", "k", "n", "all", "genders", "gender", "remote")

# Where a reply begins to quote.
QUOTE_MARKERS = ("\n-----Original Message-----", "\n________________________________", "\nOn ", "\nWrote:", "\n> ")

# Tags that begin or end a line of text.
LINE_TAGS = ("p", "br", "div", "li", "ul", "ol", "tr", "h1", "h2", "h3", "h4", "h5", "h6")

# A block that a board puts into texts to find out who reads them.
READER_MARK = r"(?is)\n*Please mention the word\b.{0,400}?(?:see they'?re human\.|\z)"

# Where a posting says the work is done.
EXPLICIT_REMOTE = r"\b(?:fully|100\s*%|entirely|completely)[\s-]*remote\b|\bremote[\s-]*(?:first|only)\b"
HYBRID = r"\bhybrid\b|\b\d+\s*days?\s*(?:a\s*week\s*)?(?:on-?site|in\s*(?:the\s*)?office)\b"
REMOTE_HINT = r"\bremote|\bwork from home\b|\bwfh\b|удал"

# Slugs of companies in the addresses of five board vendors, and what is never one.
SLUG = r"([A-Za-z0-9][A-Za-z0-9_-]{1,78}[A-Za-z0-9])"
SLUG_PATTERNS = {
    "greenhouse": (rf"(?:job-)?boards\.greenhouse\.io/{SLUG}", rf"boards\.eu\.greenhouse\.io/{SLUG}", rf"https?://{SLUG}\.greenhouse\.io"),
    "lever": (rf"jobs\.(?:eu\.)?lever\.co/{SLUG}",),
    "ashby": (rf"jobs\.ashbyhq\.com/{SLUG}",),
    "recruitee": (rf"https?://{SLUG}\.recruitee\.com",),
    "smartrecruiters": (rf"jobs\.smartrecruiters\.com/{SLUG}", rf"careers\.smartrecruiters\.com/{SLUG}"),
}
NOT_A_SLUG = ("embed", "jobs", "job", "board", "boards", "api", "www", "search", "apply", "careers", "job_board", "job-boards", "static", "assets", "images", "css", "js", "s", "c")

# Legal forms and general words in company names, for guesses at slugs.
LEGAL_FORM = (
    r"\b(?:sp\.?\s*z\s*o\.?\s*o\.?|s\.?\s?a\.?|gmbh|mbh|ag|ltd\.?|limited|inc\.?|llc|corp\.?|co\.?|plc|b\.?v\.?|n\.?v\.?"
    r"|oy|ab|a/s|kft|s\.?r\.?l\.?|pvt\.?|private|sdn\.?\s*bhd\.?|e\.?\s?v\.?|holding|group|technologies|technology"
    r"|solutions|services|consulting|software|systems|labs|international|global|digital)\b"
)

# Subjects of employer notices, in the order they are tried, and their kinds.
NOTICE_SUBJECTS = (
    ("Работодатель не готов пригласить вас", "rejection"),
    ("Новое сообщение от работодателя", "chat"),
    ("Новое сообщение в чате", "chat"),
    ("Сообщение от работодателя", "vacancy_message"),
    ("Вам написали по вакансии", "vacancy_message"),
    ("вам написали из", "message_from"),
)

# The rule engine. Places of work, in Latin (whole words) and Cyrillic (stems).
STOP_PLACES_LATIN = (
    "russia|russian federation|belarus|belarusian",
    "moscow|saint[- ]petersburg|st\\.? petersburg|petersburg|novosibirsk|y?ekaterinburg|kazan|nizhny novgorod|chelyabinsk"
    "|samara|omsk|rostov[- ]on[- ]don|ufa|krasnoyarsk|voronezh|volgograd|krasnodar|saratov|tyumen|tolyatti|izhevsk"
    "|barnaul|ulyanovsk|irkutsk|khabarovsk|yaroslavl|vladivostok|makhachkala|tomsk|orenburg|kemerovo|novokuznetsk"
    "|ryazan|astrakhan|naberezhnye chelny|penza|lipetsk|kirov|cheboksary|kaliningrad|kursk|ulan[- ]ude|stavropol"
    "|sochi|tver|magnitogorsk|ivanovo|bryansk|belgorod|surgut|kaluga|smolensk|volzhsky|cherepovets|vologda|saransk"
    "|yakutsk|innopolis|podolsk|kolpino|balashikha|khimki|mytishchi|korolev|lyubertsy",
    "minsk|gomel|homel|mogilev|mahilyow|vitebsk|vitsebsk|grodno|hrodna|bobruisk|babruysk",
)
STOP_PLACES_CYRILLIC = (
    "росси|беларус|рф\\b",
    "москв|санкт-петербург|петербург|новосибирск|екатеринбург|казан|нижн(?:ий|ем) новгород|челябинск|самар|омск|ростов"
    "|уфа|уфе|красноярск|воронеж|перм|волгоград|краснодар|саратов|тюмен|тольятти|ижевск|барнаул|ульяновск|иркутск"
    "|хабаровск|ярославл|владивосток|махачкал|томск|оренбург|кемеров|новокузнецк|рязан|астрахан|набережные челны|пенз"
    "|липецк|киров|чебоксар|тула|туле|калининград|курск|улан-удэ|ставропол|сочи|твер|магнитогорск|иванов|брянск"
    "|белгород|сургут|калуг|смоленск|волжский|череповец|вологд|саранск|якутск|иннополис|подольск|колпино|балаших|химки"
    "|мытищ|королёв|королев|люберц",
    "минск|гомел|могил[её]в|витебск|гродн|бобруйск|брест",
)
STOP_PLACES = r"\b(?:" + "|".join(STOP_PLACES_LATIN) + r")\b|\b(?:" + "|".join(STOP_PLACES_CYRILLIC) + ")"
LOCAL_PLACES = r"montenegro|crna gora|podgoric|budva|tivat|kotor|herceg[- ]novi|nik[sš]i[cć]|черногор|подгориц|будв|тиват|котор"

GEO_LOCKED = (
    r"authorized to work in the|must be authorized to work|must be (?:based|located|residing) in|must reside in"
    r"|(?:us|usa|u\.s\.|uk|eu|eea)[-\s]?only\b|only\s+(?:us|usa|uk|eu)\b|u\.?s\.? citizens?|citizens? only"
    r"|citizens? or permanent residents|green card"
)
CONTRACTOR_OK = r"\b(?:contractor|b2b|c2c|corp[-\s]to[-\s]corp|independent contractor|self[-\s]employed|freelanc)"
REGION_OK = r"europe|\beu\b|\beea\b|\bemea\b|anywhere|world-?wide"
REGION_AS_REQUIREMENT = (
    r"\b(?:eu|eea|european)\b[\w\s,/()-]{0,30}?\b(?:citizen\w*|national(?:s|ity)?|passport|work permit|residen\w+)\b"
    r"|\bcitizens?(?:hip)?\s+(?:of|in)\s+(?:the\s+)?(?:eu|eea|europe\w*)\b"
)
AUTHORIZATION_OPEN = r"\b(?:all|any)\b[\w\s,]{0,30}?work authoriz"
NO_SPONSORSHIP = (
    r"\b(?:no|not|without|cannot|can't|unable|won't)\b[^\n.;!?]{0,40}?\bsponsor\w*"
    r"|\bsponsor\w*\b[^\n.;!?]{0,25}?\b(?:not available|not offered|not provided|not possible|unavailable)\b"
)
CLEARANCE = (
    r"\bsecurity clearance\b|\b(?:sc|dv|ts/sci|ts-sci|bpss|nppv|ctc|nato|dod|doe|public trust)\s+clearance\b"
    r"|\b(?:secret|top secret)\s+clearance\b|\bactive\s+(?:ts|sci|secret|top secret)\b"
    r"|\bclearance\s*(?:level)?\s*:?\s*(?:required|eligible|active)\b"
)
LANGUAGES = (
    r"german|deutsch\w*|polish|polski\w*|polskiego|french|fran[cç]ais|spanish|espa[nñ]ol|dutch|nederlands|italian"
    r"|italiano|portuguese|portugu[eê]s|czech|swedish|norwegian|danish|finnish|hebrew|turkish|japanese|mandarin"
    r"|chinese|korean|arabic|hungarian|romanian|greek|ukrainian|franz[oö]sisch\w*|spanisch\w*|niederl[aä]ndisch\w*|niemieck\w*"
)
LANGUAGE_REQUIRED = (
    r"\b(?:fluent(?:ly)?|native|proficien\w+|business[- ]level|excellent|very good|sehr gute?|flie[sß]end\w*"
    r"|verhandlungssicher\w*|ausgezeichnete?|bardzo dobra)\b[^\n.;!?•]{0,30}\b(?:" + LANGUAGES + r")\b"
    r"|\b(?:" + LANGUAGES + r")\b[^\n.;!?•]{0,25}\b(?:required|mandatory|is a must|a must|essential|erforderlich"
    r"|vorausgesetzt|wymagany|wymagana)\b"
    r"|\b(?:" + LANGUAGES + r")\s*(?:language\s*)?(?:skills?\s*)?(?:level\s*)?\(?[abc][12]\b"
    r"|\bmust\s+(?:speak|be fluent in)\b[^\n.;!?•]{0,25}\b(?:" + LANGUAGES + r")\b"
    r"|\b(?:" + LANGUAGES + r")[-\s]speaking\b(?!\s+(?:market|clients?|customers?|countries))"
    r"|\b(?:" + LANGUAGES + r")kenntnisse\b|znajomo\w*\s+j[eę]zyka\s+(?:polskiego|niemieckiego)"
)
#: What every match of LANGUAGE_REQUIRED holds.
LANGUAGE_NAMED = r"\b(?:" + LANGUAGES + r")"
LANGUAGE_OPTIONAL = (
    r"\b(?:is|are|would be|as)\s+(?:a\s+)?(?:plus|bonus|advantage|nice[- ]to[- ]have|beneficial|welcome|appreciated"
    r"|desirable|helpful|optional)\b|\bnot\s+(?:required|mandatory|necessary|a must)\b|von vorteil|w[uü]nschenswert"
    r"|keine voraussetzung|mile widziane|\bor\s+english\b|\benglish\s+or\b|oder englisch"
)
CLAUSE_ENDS = r"[\n•;!?]|(?<=[a-z0-9)])\.(?=\s+[A-ZÄÖÜ])"
JUNIOR_TITLE = r"\b(?:junior|jr\.?|intern(?:ship)?|trainee|entry[-\s]?level|new[-\s]?grad(?:uate)?)\b|стаж[её]р|младш|джуниор|начинающ"
MIDDLE_TITLE = r"\b(?:middle|mid[-\s]?level|mid[-\s]?senior|senior|sr\.?|lead|staff|principal|architect)\b|миддл|мидл|сеньор|ведущ|старш"
TRAINING_TITLE = r"\b(?:machine[-\s]learning engineer|ml engineer|ml scientist|machine[-\s]learning scientist|deep[-\s]learning (?:engineer|scientist))\b"
PLATFORM_TITLE = r"platform|infrastructure|\binfra\b|backend|back[-\s]end|devops|mlops|data engineer"
JUNK_TITLES = (
    "apply now", "couldn't pick up that page", "create your own role", "details", "expression of interest", "hiring",
    "job", "job details", "job posting title", "job title", "join our team", "jop posting title", "no title",
    "page not found", "test job", "this is a test job", "untitled", "vacancy", "we are hiring",
)
HIRING_WORDS = (
    r"experience|responsibilit|requirement|qualification|we are looking|you will|your profile|skills|salary|apply"
    r"|benefits|\bteam\b|\brole\b|position|hiring|join us|candidate|erfahrung|aufgaben|kenntnisse|bewerb|mitarbeit|stelle"
    r"|stanowisko|wymagania|obowi|poszukujemy|oferujemy|umiej|praca|empleo|puesto|experiencia"
    r"|опыт|обязанност|требован|вакансия|зарплат|команд|разработчик|инженер"
)
TRUNCATED, PROSE = r"…|\.\.\.|¦", r"[.!?]"
PASSPORT = r"\bvalid\s+(?:international\s+)?passport\b|\bpassport\s+(?:is\s+)?required\b|\binternational\s+passport\b|загранпаспорт|заграничн\w+\s+паспорт"
RELOCATION = (
    r"visa sponsorship|sponsor\w*\s+(?:your\s+)?(?:work\s+)?visa|work permit sponsor|willing(?:ness)?\s+to\s+relocate"
    r"|ready to relocate|relocation\s+(?:support|package|assistance)|релокац"
)
PROGRAMMING = r"java|python|\.\s?net|c#|c\+\+|javascript|typescript|php|ruby|golang|kotlin|swift|scala"
LANGUAGE_SOUP = r"(?:\b(?:" + PROGRAMMING + r")\b[\s,/]+){3,}(?:(?:and|or)\s+)?\b(?:" + PROGRAMMING + r"|similar)\b"
BOILERPLATE = r"write clean(?:,?\s+(?:and\s+)?(?:efficient|readable|maintainable))?\s+code|develop,?\s+test,?\s+and maintain software"

# What a teletype post's first line has to hold to be its place, how much of it is kept, and
# where its id stands.
GEO_LINE = r"\b(?:remote|relocation|on-?site|hybrid|only)\b"
GEO_LENGTH = 200
REMOTE_WORD = r"\bremote\b"
POST_SLUG = r"teletype\.in/@[^/]+/([^/?#]+)"

# Lines of job alerts that are no place, company or title, and the words that mark others.
HH_PAY = r"^(от|до)\s|^[\d\s.,]+[₽$€]?$|^[₽$€]$|^за\s+(месяц|год|час|день|смену)$"
HH_END = "Посмотреть вакансию"
REMOTE_RU = "Можно удал"
LINKEDIN_NOISE = r"actively recruiting|school alum|be an early applicant|easy apply|promoted|viewed|your profile|response"
GLASSDOOR_NOISE = r"Employer est\.|Easy Apply|Just posted|^\d+[hdwm]$|See more jobs|Want more"
BADGES = ("Actively Hiring", "Our take", "Learn more")
DETAIL_KINDS = (
    ("pay", r"[$¢£¤¥\u20a0-\u20cf]|(?i:\d\s*%|no equity)"),
    ("experience", r"years of exp"),
    ("type", r"^(?:Full-time|Part-time|Contract|Internship)$"),
)
