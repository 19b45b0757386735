"""Word lists, codes and patterns that results depend on, as plain text."""

from __future__ import annotations

# --- fixed values: names ---------------------------------------------------------------------------------------------
#: Ranks and honorifics that are no part of a name.
RANKS = tuple(
    "amn a1c sra ssgt tsgt msgt smsgt cmsgt ccm 2lt 1lt capt maj ltcol col briggen majgen ltgen gen pvt pfc spc cpl sgt sfc 1sg sgm csm ens ltjg lcdr cdr cpt cwo wo mr mrs ms miss dr sir madam sa det ofc officer agent inv".split()
)
SUFFIXES = tuple("jr sr ii iii iv phd md esq".split())

# --- fixed values: dates ---------------------------------------------------------------------------------------------
#: Months by their first three letters, and how they are written.
MONTHS = tuple("jan feb mar apr may jun jul aug sep oct nov dec".split())
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
#: Values that stand for no date.
NO_DATE = ("null", "none", "unknown", "n/a", "n/a.")
#: Ordinals that name a day: those before twenty alone, the first nine also after twenty and thirty.
ORDINALS = tuple(
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
)
#: Ends of predicates that bound a period rather than date an event.
BOUNDARY = r"(?i)(?:^|\s)(?:since|until|till|as of|up to|up until|prior to)$"
#: Words that hedge a date, with the date that they must stand before.
HEDGE = (
    r"(?i)\b(?:around|about|approximately|roughly|sometime|somewhere|mid|early|late)[\s-]+(?:(?:in|of|the|on)\s+)?(?:(?:mid|early|late)[\s-]+)?"
    rf"(?:\d{{1,2}}(?:st|nd|rd|th)\b|\d{{1,2}}[\s-]+(?:{MONTH})\b|(?:{MONTH})\b|(?:19|20)\d{{2}}\b|(?:mon|tues|wednes|thurs|fri|satur|sun)day\b|week|month|year|morning|afternoon|evening|night)"
    r"|\bor so\b|\bthereabouts\b"
)
#: Times of day, civil or military.
CLOCK = (
    r"(?i)\b\d{1,2}:[0-5]\d\b|\b(?:at|around|about|approximately|by|until|since|from|before|after)\s+(?<![\d.$])(?:[01]\d|2[0-3])[0-5]\d\b(?!\.\d)"
    r"|(?<![\d.$])\b(?:[01]\d|2[0-3])[0-5]\d\s*(?:hrs?|hours|[LZ])\b|\b(?:noon|midnight|[ap]\.?m\.?)\b"
)
#: Words that take something out of a series of dates.
EXCLUSION = r"(?i)\b(?:not|never|except|excluding|but|only|missed|absent|declined|neither|nor|without)\b"

# --- fixed values: claims, kinds and roles -----------------------------------------------------------------------------
#: Verb-like words of a proposition.
VERBISH = (
    r"(?i)\b(is|are|was|were|be|been|being|has|have|had|do|does|did|said|stated|told|saw|heard|asked|went|came|gave|took|made|"
    r"would|could|should|will|shall|may|might|must|can|\w+ed|\w+ing|\w+s)\b"
)
#: Kinds of documents by their name and first text; the first that matches counts, so structure comes before content.
KINDS = [
    ("statement", r"(?i)\b(sworn statement|statement of witness|affidavit|under (oath|penalty of perjury))"),
    ("interview", r"(?i)(^|\n)\s*(q|question|io)\s*[:.]|\b(interview (of|with|transcript)|transcript of interview|interviewee\s*[:.])"),
    ("appointment", r"(?i)\b(memorandum for|appointment (memo|letter)|appointed to conduct|investigating officer is appointed)"),
    ("notes", r"(?i)\b(working notes|io notes|investigator(?:'s)? notes)"),
    ("record", r"(?i)\b(log|logbook|ledger|register|system report|report generated|proxy log|access log|audit trail|export|certificate|calibration record|maintenance record|orders|form \d)"),
]
#: Roles of a speaker by the first text, then by words of the name.
ROLES = [
    ("subject", r"(?i)\b(subject of (this|the) investigation|you are the subject|subject interview|as the subject)\b"),
    ("custodian", r"(?i)\b(custodian|network administrator|system administrator|records? (manager|monitor|keeper)|calibration monitor|i (maintain|administer|keep|run) the (log|system|records?)|i pulled the (log|report)|i am responsible for the records?)\b"),
    ("complainant", r"(?i)\b(complainant|i filed (a|the) complaint|i reported (him|her|them|it) to)\b"),
    ("supervisor", r"(?i)\b(section chief|flight chief|supervisor|i supervise|in my capacity as (his|her|their) supervisor)\b"),
]
ROLE_NAMES = [("subject", "subject"), ("custodian", "custodian|admin|monitor|records"), ("complainant", "complainant"), ("supervisor", "supervisor|sectionchief|chief")]
#: Who speaks where nothing tells.
NO_ROLE = "witness"
#: A line that heads an allegation: decoration around it, perhaps a speaker before it, and a stop or the line's end after it.
_LEAD = r"[ \t>|]*(?:(?:#{1,6}|[-+•]|\d{1,3}[.)])[ \t]*)*(?:[*_~`]+[ \t]*)*"
_WRAP = r"[*_~`]*"
MARKER = (
    rf"(?i)^{_LEAD}(?:[A-Z][A-Za-z. ]{{0,14}}{_WRAP}:{_WRAP}[ \t]*)?{_WRAP}(?:allegation|specification){_WRAP}[ \t]*(?::{_WRAP}[ \t]*)?{_WRAP}(?:no\.?|#)?[ \t]*{_WRAP}"
    rf"(\d{{1,2}}|[ivx]{{1,4}})\b{_WRAP}[ \t]*(?:[.:)|–—-]|[*_~`\s]*$)"
)
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}

# --- fixed values: what a name is ---------------------------------------------------------------------------------------
#: Words that stand for someone without naming them.
PRONOUNS = ("i", "me", "you", "he", "she", "they", "we", "the interviewee", "interviewee", "unknown", "the subject", "the witness", "io", "the member", "the investigator")
#: Groups, alone or behind "the".
COLLECTIVES = tuple(
    "airmen airman personnel members member troops crew shop team staff squadron flight section unit others everyone someone somebody people witnesses subordinates coworkers colleagues leadership supervisors management".split()
)
#: Words of jobs, and words that stand beside them in a job's name.
ROLE_WORDS = tuple(
    "administrator technician craftsman journeyman apprentice chief supervisor monitor manager officer commander custodian operator specialist analyst inspector superintendent director noncommissioned nco ncoic oic section flight squadron shop clerk assistant".split()
)
ROLE_FILLERS = tuple("the a an of and civilian test equipment network".split())
#: What begins a person's name, and what stands anywhere in one.
HONORIFICS = tuple("a1c amn sra ssgt tsgt msgt smsgt cmsgt 2lt 1lt capt maj lt ltcol col gen mr mrs ms miss dr sir madam civ".split())
NAME_RANKS = tuple("msgt ssgt tsgt smsgt cmsgt sra amn a1c capt maj lt col gen sgt mr mrs ms dr det ofc sfc cpl pvt".split())
#: Furniture of forms: a blank that waits for ink.
BLANK = r"_{3,}|\.{4,}|\[\s*\]|\(\s{3,}\)"
#: Nouns behind which "I" is a numeral.
DESIGNATORS = tuple(
    "section subsection paragraph part phase annex appendix attachment enclosure exhibit tab chapter article volume figure table item line class type group category level tier building room wing zone gate stage step schedule title".split()
)
#: Words of speech behind a name; words before and behind the name of somebody who is heard.
SPEECH = tuple("said says told shouted yelled replied answered remarked".split())
HEARING, HEARD = tuple("heard watched saw".split()), tuple("say saying tell telling shout shouting yell yelling".split())
NOT_A_NAME = tuple(
    "i he she they we you it that this these those the a an who what when where which and but then so if as after afterward afterwards before later once while because eventually finally meanwhile anyway also next airman airmen everyone someone somebody nobody people personnel witnesses members leadership command".split()
)
#: Labels of a form that stand before when a proceeding took place.
DATE_LABELS = ("date / time / location", "date/time/location", "date and time", "date of interview", "date of statement", "date taken", "date")

# --- fixed values: what of a key is distinctive ---------------------------------------------------------------------------
#: Dates, money, grouped or fractional numbers and cited authorities.
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
KEY_FIGURES = (
    r"\b\d{4}-\d{2}-\d{2}\b",
    rf"(?i)\b\d{{1,2}}\s+(?:{_MONTHS})\w*\b",
    rf"(?i)\b(?:{_MONTHS})\w*\s+\d{{4}}\b",
    r"\$[\d,]+(?:\.\d{2})?",
    r"\b\d{1,3}(?:,\d{3})+(?:\.\d{2})?\b",
    r"\b\d+\.\d{2}\b",
    r"\b(?:AFI|OI|DAFI|AFMAN|DoDI|DoD)\s*[\d][\d.\-]*",
    r"\bArticle\s+\d+\b",
)
#: Words of names and titles that are evidence of nothing.
COMMON = tuple(
    "the and for with that this from have been were was are not but all any one two three four five six seven eight nine ten first second third other some such only into over under after before since until date time page statement report interview witness subject officer person people evidence fact facts allegation allegations investigation investigator record records msgt ssgt tsgt smsgt cmsgt sra amn a1c capt maj col gen sgt lieutenant colonel major captain sergeant airman master senior chief technical staff mister missus doctor".split()
)
