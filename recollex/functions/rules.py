"""Pattern banks and word lists as data, and the columns that apply them.

A bank is an ordered list of (label, patterns); the first label with a matching pattern wins. Patterns are
case-insensitive and written for Java's regular expressions. DuckDB's engine has no lookaround, so `portable` says
whether an oracle may run a pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: means of knowledge, in order of precedence, and their strengths ----
PRAMANA = [
    ("shabda", [
        r"\b(?:my|the|a|an|her|his|their)?\s*\w*\s*(?:told\s+me|said\s+to\s+me|told\s+us|mentioned|informed\s+me|reported|reports)\b",
        r"\baccording\s+to\b",
        r"\b(?:i\s+was\s+told|we\s+were\s+told|i\s+heard\s+that|i\s+heard\s+from)\b",
    ]),
    ("pratyaksa", [
        r"\b(?:i|we)\s+(?:saw|see|watched|witnessed|observed|noticed|heard(?!\s+(?:that|from)))\b",
        r"\b(?:i|we)\s+(?:felt|smelled|tasted|touched)\b",
    ]),
    ("anupalabdhi", [
        r"\b(?:i|we)\s+(?:don'?t|didn'?t|do\s+not|did\s+not)\s+(?:see|hear|notice|observe|find)\b",
        r"\b(?:there\s+is|was)\s+no\b.*\b(?:sign|trace|evidence)\b",
    ]),
    ("arthapatti", [
        r"\bmust\s+(?:have\s+been|be|have)\b",
        r"(?s)\b(?:since|because|given\s+that).{1,60}\b(?:therefore|so|hence|it\s+follows)\b",
    ]),
    ("anumana", [
        r"\b(?:i\s+think|i\s+believe|i\s+suspect|probably|seems\s+(?:like|that)|likely|apparently)\b",
        r"\b(?:if|when)\b.{1,50}\b(?:then|so)\b",
    ]),
    ("upamana", [
        r"\b(?:like|similar\s+to|resembles|as\s+if|much\s+like|akin\s+to)\b",
        r"\b(?:compared\s+to|in\s+comparison\s+with|as\s+\w+\s+is)\b",
    ]),
]
PRAMANA_STRENGTH = {"pratyaksa": 1.0, "anumana": 0.8, "arthapatti": 0.7, "anupalabdhi": 0.65, "shabda": 0.6, "upamana": 0.55, "unknown": 1.0}
PRAMANA_MISSING = 0.7

# ---- Fixed values: kinds of negation, in order, and the cues that gate them ----
NEGATION = [
    ("atyantabhava", [
        r"\b(?:i|we)(?:\s+have|\s*'ve|\s+never\s+have)\s+never\b",
        r"\b(?:i|we)'ve\s+never\b",
        r"\b(?:not\s+once|in\s+my\s+life\s+i\s+have\s+never)\b",
        r"\b(?:there\s+has\s+never\s+been|there\s+never\s+was)\b",
    ]),
    ("pradhvamsabhava", [
        r"\bno\s+longer\b",
        r"\b(?:i|we)\s+(?:stopped|quit|gave\s+up|ended|finished|dropped|cancell?ed|called\s+off)\b",
        r"\b(?:cancell?ed|called\s+off)\s+(?:the|my|our|it)\b",
        r"\b(?:i|we)\s+used\s+to\s+\w+\s+(?:but|however)\b",
        r"\b(?:i|we)\s+don'?t\s+\w+(?:\s+\w+){0,5}\s+(?:anymore|any\s+more|any\s+longer)\b",
    ]),
    ("pragabhava", [
        r"\b(?:i|we)\s+(?:haven'?t|have\s+not|hasn'?t|has\s+not)\s+\w+.{0,30}\byet\b",
        r"\b(?:i|we)\s+(?:hasn'?t|haven'?t|have\s+not)\s+(?:started|begun)\b",
        r"\bnot\s+(?:yet|still\s+not)\b.{0,40}",
    ]),
    ("anyonyabhava", [
        r"\b(?:i|we|he|she|they)\s+(?:am|is|are)\s+not\s+(?:a|an|the)\s+\w+",
        r"\b\w+\s+is\s+not\s+(?:a|an|the)\s+\w+",
    ]),
]
NEGATION_CUES = [
    "not", "never", "no ", "don't", "didn't", "doesn't", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "won't", "wouldn't", "shouldn't", "couldn't", "stopped", "quit", "gave up", "ended", "no longer", "used to", "cancelled", "canceled", "called off",
]

# ---- Fixed values: markers that a later statement replaces, or only adds to, an earlier one ----
SUPERSESSION = [
    r"\bi\s+now\s+\w+", r"\bnow\s+i\s+\w+", r"\bthese\s+days\b", r"\bno\s+longer\b", r"\bnot\s+anymore\b",
    r"\bupgraded\s+(?:to|from)\b", r"\bdowngraded\s+(?:to|from)\b", r"\bswitched\s+(?:to|from)\b", r"\bswapped\s+\w+\s+(?:to|for|with)\b",
    r"\bmoved\s+(?:to|from|into|out)\b", r"\brelocated\b", r"\breplaced\b", r"\bshut\s+down\b", r"\bwound\s+down\b", r"\bcancelled\b", r"\bquit\b",
    r"\bleft\s+(?:my|the|a)\s+\w+", r"\bpassed\s+away\b", r"\bdied\b", r"\bpassed\b(?!\s+(?:the|an|my|out))", r"\bretired\b", r"\bgraduated\b",
    r"\bgot\s+(?:a\s+)?(?:new|different)\b", r"\bmy\s+new\s+\w+", r"\bis\s+new\s+(?:this|now|as\s+of)\b", r"\badopted\b",
    r"\binstead\s+of\b", r"\binstead\b", r"\bsold\s+(?:my|the|our)\b", r"\bbought\s+(?:a\s+)?new\b", r"\bstarted\s+\w+ing\b", r"\bstopped\s+\w+ing\b",
]
ADDITIVE = [
    r"\balso\b", r"\btoo\b(?!\s*(?:much|many|few|little))", r"\bas\s+well\b", r"\bin\s+addition\b", r"\badditionally\b", r"\bon\s+top\s+of\b",
    r"\bplus\b", r"\banother\b", r"\bstill\b", r"\balong\s+with\b", r"\bas\s+well\s+as\b",
]
CESSATION = [
    r"\bquit\b", r"\bstopp?ed\b", r"\bgave\s+up\b", r"\bno\s+longer\b", r"\bnot\s+anymore\b", r"\bwent\s+(?:\w+[-\s])?free\b", r"\bzero\s+\w+\b",
    r"\bcut\s+(?:out|off)\b", r"\bdeleted\b", r"\bsold\s+(?:my|the|our)\b", r"\bcancell?ed\b", r"\bentirely\b", r"\bcompletely\b",
    r"\bfully\s+\w+\b", r"\b\w+\s+fast\b", r"\bnever\s+(?:again|owning?|drink)\b",
]
RESUMPTION = [
    r"\bback\s+on\b", r"\bback\s+to\b", r"\b(?:i|i'm|im)\s+\w+\s+again\b", r"\bagain\s+now\b", r"\bresumed\b", r"\breturned\s+to\b",
    r"\bre-?joined\b", r"\bstarted\s+\w+ing\s+again\b", r"\b\w+ing\s+again\b",
]
NEGATED_RESUMPTION = [r"\b(?:not|never|no)\s+(?:\w+\s+){0,2}(?:back\s+(?:on|to)|again|resum\w*|return\w*)\b"]
SETTLEMENT = [
    r"\blanded\s+on\b", r"\bsettled\s+on\b", r"\bended\s+up\s+(?:with|at|on)\b", r"\bmy\s+rule\s+now\b", r"\bthe\s+rule\s+(?:now\s+)?is\b",
    r"\bit'?s\s+the\s+right\s+rule\b", r"\bon\s+my\s+own\s+terms\b",
]
ARRANGEMENT = [
    r"\b(?:is|are)\s+now\b", r"\bwe\s+do\s+\w+(?:\s+\w+)?\s+now\b", r"\b\w+\s+now\s+instead\b", r"\bswitched\s+\w+\s+to\b", r"\bmoved\s+my\s+\w+\s+to\b",
]
REVERSAL = [
    r"\bnot?\b", r"\bnever\b", r"\bn't\b", r"\binstead\b", r"\bwas\s+wrong\b", r"\bturns?\s+out\b", r"\bactually\b", r"\bdropped\b",
    r"\bwrong\s+for\s+me\b", r"\bstopped\b", r"\bgave\s+up\b",
]
INTENT = [
    r"\bthink(?:ing)?\s+about\b", r"\bkeep\s+(?:circling|coming|returning|stopping|pausing|browsing|looking|eyeing|staring|drifting)\b",
    r"\bcouldn'?t\s+stop\s+think\w*\b", r"\bcan'?t\s+stop\s+think\w*\b", r"\bwant(?:ed)?\s+(?:to|a|an)\b", r"\bwonder(?:ing)?\b", r"\bcurious\b",
    r"\bdrawn\s+to\b", r"\bsomething\s+(?:about|in)\b", r"\bcouldn'?t\s+look\s+away\b", r"\bfelt\s+(?:weirdly\s+)?jealous\b", r"\bstare\b|\bstaring\b",
]
INITIATION = [
    r"\bstarted\s+\w+ing\b", r"\bstarted\s+(?:a|an|the|my|our)\b", r"\bstarted\s+[A-Z]\w+\b", r"\bplanted\b", r"\bbegan\b",
    r"\b(?:my|our|went\s+to\s+(?:my|a))\s+first\b", r"\bfirst\s+(?:class|session|lesson|attempt|try)\b", r"\bsigned\s+up\s+for\b",
    r"\btaster\b|\btrial\b|\btried\b", r"\bborrowed\b|\brented\b", r"\benrolled\b|\bjoined\b",
]
REGIME = [
    r"\b(?:is|are)\s+now\b", r"\bwe\s+do\s+\w+(?:\s+\w+)?\s+now\b", r"\bnow\s+instead\b", r"\bmoved\s+(?:my|to)\b", r"\bswitched\s+\w+\s+to\b",
    r"\bevery\s+morning\s+now\b",
]

# ---- Fixed values: numbers in text ----
ATTRIBUTES = [
    ("expense", [r"\b(?:spent|spend|paid|pay|cost|costs?|price|priced|charge)\b"]),
    ("income", [r"\b(?:earned|earn|made|income|salary|revenue|profit)\b"]),
    ("fundraising", [r"\b(?:raised|donated|contribution)\b"]),
    ("savings", [r"\b(?:saved|saving|deposit)\b"]),
    ("weight", [r"\b(?:weighs?|weight)\b"]),
    ("age", [r"\b(?:age|aged?|old|years?\s+old)\b"]),
    ("duration", [r"\b(?:duration|hours?|spent.*hours?|took.*weeks?)\b"]),
]
ENTITY_ALIASES = {
    "bicycle": "bike", "bicycles": "bike", "bikes": "bike", "cycling": "bike", "subway": "transit", "bus": "transit", "train": "transit",
    "groceries": "grocery", "supermarket": "grocery", "stories": "writing", "essays": "writing", "articles": "writing", "pieces": "writing",
}
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
}
ENTITY_STOP = """the and for with from into onto this that have had has was were been being are but not any all some more most less least than then
when where what which who how why very just also even after before again still back out over under spent spend paid pay cost earned make raised saved
donated buy bought sold received got took every each many much today yesterday tomorrow morning evening night week year month day hour minute""".split()
QUESTION_STOP = """how much many what when where who why the a an is are was were do does did have has had i me my you your in on at for with from to by
of and or but than total altogether average mean more less most highest least lowest count number spent spend earn earned made raised this that these
those year month week ever all any some since start starts started starting beginning until before after during throughout money amount cost price
value expenses expense related""".split()
PROXIMITY_STOP = "money expense expenses spent spend total since start year month week day related anything all amount".split()

# ---- Fixed values: questions ----
AGGREGATIONS = [
    ("difference", [r"\b(?:how\s+much\s+more|how\s+much\s+less|difference|differs?)\b"]),
    ("average", [r"\b(?:average|mean|on\s+average)\b"]),
    ("max", [r"\b(?:most(?!\s+(?:similar|like|alike))|highest|maximum|max)\b"]),
    ("min", [r"\b(?:least|lowest|minimum|min)\b"]),
    ("sum", [r"\b(?:total|altogether|overall|sum|combined|how\s+much)\b"]),
    ("count", [r"\b(?:how\s+many|count|number\s+of)\b"]),
]
PERIOD = [
    r"\b(?:month\s+(?:to|by|over)\s+month|per\s+month|each\s+month|monthly|over\s+the\s+months?|by\s+month|year\s+(?:to|by|over)\s+year|per\s+year|each\s+year|yearly|by\s+year|over\s+the\s+(?:past\s+)?years?|over\s+time|quarter\s+(?:to|by|over)\s+quarter|per\s+quarter|week\s+(?:to|by|over)\s+week|per\s+week|each\s+week|weekly|across\s+the\s+(?:seasons|months|years))\b",
]
YEAR = [r"\b(?:year\s+(?:to|by|over)\s+year|per\s+year|each\s+year|yearly|by\s+year|over\s+the\s+(?:past\s+)?years)\b"]
EVOLUTION = [r"\b(?:evolved?|evolving|changed?|changing|trended|trends?|progressed|progression|break\s+down)\b"]
MIND_IDIOM = [r"\bchanged?\s+(?:my|our)\s+mind\b"]
QUANTITY = [r"\b(?:spending|spend|spent|costs?|donated|donations?|budget|expenses?|savings?|saved?|mileage|buying|totals?|amount)\b"]
SCALAR = [r"\b(?:in\s+total|altogether|overall|all\s+time)\b"]
ABSENCE_GUARDS = [r"\bhow\s+(?:much|many)\b", r"\b(?:more|less|fewer)\s+than\s+\$?\d", r"\b(?:over|under|at\s+least)\s+\$?\d", r"\bin\s+total\b"]
ABSENCE = [
    ("ever", r"\b(?:have|did|was|has)\s+(?:i|we)\s+ever\s+(.+?)\??$"),
    ("yet", r"\b(?:have|haven'?t|has|hasn'?t|did)\s+(?:i|we)\s+(.+?)\s+yet\b"),
    ("still", r"\b(?:do|does|am|is|are)\s+(?:i|we)\s+still\s+(.+?)\??$"),
    ("open", r"\bwhat\s+have(?:n'?t)?\s+(?:i|we)\s+(?:not\s+)?(.+?)\??$"),
    ("open", r"\b(?:is\s+there\s+)?anything\s+(?:i|we)\s+(?:still\s+)?haven'?t\s+(.+?)\??$"),
    ("ever", r"\b(?:what|which|any\s+part\s+of|anything)\b.{0,40}?\b(?:have|has|did)\s+(?:i|we)\s+never\s+(.+?)\??$"),
    ("ever", r"\bany\s+part\s+of\s+(.+?)\s+(?:i|we)\s+never\b"),
    ("open", r"\bwhat'?s\s+still\b.{0,40}?\b(?:i|we)\s+haven'?t\s+(.+?)\??$"),
    ("ever", r"\bhave\s+(?:i|we)\s+\w+\s+anything\s+(?:on|about|for|with)\s+(.+?)\??$"),
    ("identity", r"\bam\s+i\s+(?:a|an|the)\s+(.+?)\??$"),
    ("identity", r"\bis\s+([A-Z]\w+)\s+my\s+(.+?)\??$"),
]
ABSENCE_NEEDS_NEGATION = [r"\b(?:not|haven'?t|hasn'?t)\b"]
ANALOGY = [
    r"\bremind(?:s|ed)?\s+me\b", r"\b(?:been|was)\s+in\s+a\s+situation\s+like\b", r"\bsomewhere\s+like\s+this\b", r"\bsituation\s+like\s+this\b",
    r"\blike\s+this\s+before\b", r"\bwhen\s+have\s+i\s+(?:handled|met|seen|faced|felt)\b", r"\bwhere\s+have\s+i\s+(?:seen|met)\s+this\b",
    r"\bwhat\s+past\s+\w+\s+(?:was|is)\s+(?:most\s+)?(?:similar|like)\b", r"\bmaps?\s+onto\s+this\b", r"\bwhat\s+past\s+experience\b",
    r"\bgoing\s+like\s+the\s+last\s+one\b", r"\bthe\s+last\s+time\s+i\s+felt\b", r"\bis\s+there\s+a\s+pattern\s+in\b", r"\brun\s+this\s+playbook\s+before\b",
    r"\bbet\s+on\s+\w+\s+like\s+this\b", r"\bapproached\s+something\s+this\s+way\b", r"\bwhere\s+have\s+i\s+seen\s+this\s+pattern\b",
    r"\blearned\s+this\s+lesson\s+somewhere\b", r"\bmet\s+this\s+temptation\b", r"\b(?:anything|something)\s+in\s+my\s+past\s+like\b",
    r"\bin\s+my\s+past\s+like\s+this\b", r"\bresembles?\b", r"\bclosest\s+thing\s+in\s+my\s+past\b", r"\bdoes\s+this\s+\w+(?:\s+\w+)?\s+mirror\b",
    r"\bmirror(?:s|ed)?\s*\?$", r"\bis\s+this\s+like\s+the\s+time\b", r"\bfaced\s+before\b", r"\bmost\s+(?:similar|like|alike)\b", r"\bfelt\s+most\s+like\b",
]
NARRATIVE = [
    ("origin", [r"\bwhen\s+did\s+i\s+(?:first|start|begin)\b|\b(?:the\s+)?first\s+time\s+i\b|\bhow\s+did\s+i\s+(?:get\s+into|come\s+to|start|begin|first)\b|\bwhat\s+(?:got|made|led)\s+me\s+(?:into|to)\b|\bwhere\s+did\s+(?:my|this)\b.{0,40}?\bcome\s+from\b"]),
    ("evolution", [r"\bhow\s+(?:has|have|did|'?s)\b.{0,40}?(?:evolv|chang|shift|develop|progress|grow|grew|matur|come\s+around)|\bevolv(?:ing|ed|ution)\s+(?:view|thinking|stance|position|opinion|thoughts?|take)|\bmy\s+evolving\b|\bhow\s+(?:my|i)\b.{0,30}?(?:changed|evolved)\s+over\b"]),
    ("throughline", [r"\bthrough[\s-]?line\b|\btrace\s+(?:my|the)\s+(?:thinking|thoughts|reasoning|views?|journey|arc)\b|\btrace\s+how\b|\bback\s+and\s+forth\b|\bwhat'?s\s+the\s+(?:arc|story|trajectory|narrative|thread|throughline)\b|\bpatterns?\s+in\s+how\s+i\s+(?:think|write|feel|approach|talk|reason)\b|\bthe\s+thread\s+(?:running\s+)?through\b|\bhow\s+do\s+my\b.{0,40}?\b(?:connect|relate|fit\s+together)\b"]),
    ("evolution", [r"\brelationship\s+with\b.{0,50}?\b(?:chang|evolv|shift|gone|grown|develop)"]),
]
LOOKUP = [
    r"\bwhat\s+(?:do\s+)?(?:i|you|the\s+user)\s+(?:currently|now|still)\s+(?:believe|think|feel|prefer|do|like|eat|drink|use|own)",
    r"\b(?:what|where|how|when|who)\s+(?:does|is)\s+(?:the\s+user|they|i|you)\b[^?]*\b(?:now|currently|today)\b",
    r"\b(?:is|does|do)\s+(?:the\s+user|they|i|you)\s+(?:still|currently|now)\b",
    r"\bwhat\s+is\s+(?:the\s+user'?s?|my|your)\s+current\b",
    r"\bwhat\s+\w+\s+(?:does|is)\s+.{1,40}\b(?:currently|now)\b",
    r"\b(?:who|what|where|how)\s+(?:is|are)\s+(?:currently|now)\b",
    r"\bwhen\s+did\s+(?:the\s+user'?s?|my|your)\b.*\b(?:change|move|switch|start|stop)\b",
    r"\bwhen\s+did\s+.{1,40}\b(?:change|move|switch|start|stop)\b",
    r"\bdoes\s+(?:the\s+user|they|i|you)\s+(?:currently|still|now)\b",
]

# ---- Fixed values: words that carry no topic ----
BM25_STOP = """a an the is it of in to and or for on at by be as do if so no not are was were been has had have will can may this that with from""".split()
PRF_STOP = """a an the is are was were be been being have has had do does did will would shall should may might can could must need i me my we us our
you your he him his she her it its they them their this that these those what which who whom where when why how and or but not no nor if then so too
very just also of in on at to for with by from up about into over after""".split()
ABBREVIATIONS = "mr mrs ms dr st jr sr prof rev vs etc e.g i.e cf fig no approx inc ltd co corp".split()


def portable(pattern: str) -> bool:
    """Whether an engine without lookaround can run the pattern."""
    return not any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!"))


#: Openings of groups, classes, escapes, and the characters that Java and RE2 read in different ways.
_PART = re.compile(r"\(\?[a-z<]*[:=!)]|\[\^?(?:\\.|[^\]\\])*\]|\\.|[ksKS.]")
_FOLDED = {"k": "\u212a", "s": "\u017f"}
#: What stands for these two, and for any other character beyond ASCII, where edges of words are looked for.
_SIGNS = {"\u212a": "\u00a5", "\u017f": "\u00a7"}
_OTHER = "\u00a4"


def as_re2(pattern: str) -> str:
    """A case-insensitive pattern that finds in Java what RE2 finds, but for edges of words, which need `signs`.

    RE2 folds the Kelvin sign and the long s, takes only a line feed out of the dot, and has no vertical tab in its
    white space.
    """

    def part(found: re.Match) -> str:
        p = found[0]
        if p.startswith("["):
            body = p[:-1].replace(r"\s", r"\t\n\f\r ")
            plain = body.replace("[^", "[", 1).replace(r"\p{L}", "").replace(r"\p{N}", "") + "]"
            return body + "".join(f for c, f in _FOLDED.items() if re.match(plain, c, re.IGNORECASE)) + "]"
        known = {r"\s": r"[\t\n\f\r ]", r"\w": "[0-9A-Za-z_\u212a\u017f]", ".": r"." if "(?s)" in pattern else r"[^\n]"}
        return known.get(p) or (f"[{p}{_FOLDED[p.lower()]}]" if p.lower() in _FOLDED else p)

    return "(?i)" + _PART.sub(part, pattern)


def matches(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern of a bank occurs in the text."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def signs(text: Column) -> Column:
    """The text with signs for all characters beyond ASCII, as RE2's words end at those and Java 17's don't at letters."""
    kept = "".join(_SIGNS)
    return F.translate(F.regexp_replace(text, rf"[^\x00-\x7f{kept}]", _OTHER), kept, "".join(_SIGNS.values()))


def matches_portable(text: Column, patterns: list[str]) -> Column:
    """Whether any portable pattern of a bank occurs in the text, as RE2 reads it: the test of sql_matches."""
    return signs(text).rlike("|".join(f"(?:{as_re2(p)})" for p in patterns if portable(p)).translate(str.maketrans(_SIGNS)))


def label(text: Column, bank: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The first label whose patterns occur in the text."""
    out = F.lit(otherwise).cast("string")
    for name, patterns in reversed(bank):
        out = F.when(matches(text, patterns), F.lit(name)).otherwise(out)
    return out


def sql_matches(column: str, patterns: list[str]) -> str:
    """The test of matches_portable for DuckDB."""
    joined = "|".join(f"(?:{p})" for p in patterns if portable(p)).replace("'", "''")
    return f"regexp_matches({column}, '(?i){joined}')"


def sql_label(column: str, bank: list[tuple[str, list[str]]], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {sql_matches(column, patterns)} THEN '{name}'" for name, patterns in bank)
    return f"CASE {whens} ELSE {otherwise} END"
