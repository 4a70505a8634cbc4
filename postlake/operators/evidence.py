"""What a posting and its employer's record say about visa sponsorship."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches
from ..schema import EMPLOYER_SCORES

# The grammar of refusals: words by role. A rule is a row of roles, with the fillers that may stand between two of them.
WORDS = {
    "not": r"(?:not|never|cannot|can['’]?t|won['’]?t|don['’]?t|doesn['’]?t|isn['’]?t|aren['’]?t|unable)",
    "act": r"(?:provid|offer|support|sponsor|accommodat|accept|process|transfer|consider|employ|assist)(?:e|es|ed|ing|s)?",
    "done": r"(?:available|provided|offered|supported|accepted|accommodated|considered|processed|possible|eligible)",
    "visa": r"(?:visas?|immigration|h-?1bs?)",
    "permit": r"(?:work|employment)[ -](?:authorization|visas?)",
    "sponsorship": r"sponsorships?",
    "help": r"(?:sponsorships?|transfers?|assistance|support)",
    "kind": r"(?:current|future|new|or|work|employment|visa|immigration|h-?1b)",
    "open": r"(?:eligible|open|available)",
    "need": r"(?:requir|need)(?:e|es|ed|ing|s)?",
    "who": r"(?:we|the company)",
}
TOPIC = rf"(?:{WORDS['visa']}|{WORDS['permit']}|{WORDS['sponsorship']})"
#: Up to so many characters of the same sentence.
_SOME = r"[^.!?\n]{{0,{}}}".format


def rule(text: str) -> str:
    """A pattern from a row of roles: names in braces are WORDS, <n> is up to n characters of the sentence, a blank is white space."""
    out = text
    for name, words in {**WORDS, "topic": TOPIC}.items():
        out = out.replace("{" + name + "}", words)
    for n in (20, 40, 60, 100, 240):
        out = out.replace(f"<{n}>", _SOME(n))
    return r"\b" + out.replace(" ", r"\s+")


REFUSALS = [
    r"{not}(?: (?:be|able|to|currently|in|a|position|will|yet))* {act}\b<100>\b{topic}",  # will not sponsor ... visas
    r"not be able\b<240>\b{act}\b<100>\b{topic}",  # may not be able to ... support ... sponsorship
    r"(?:{topic}|{visa} {help}|{visa} candidates?|{permit})(?: for<40>)?:?(?: (?:is|are|will|would|can))* (?:{not}(?: be)? {done}|unavailable)\b",  # sponsorship is not available
    r"{sponsorship}\s*:\s*(?:no|none)\b",
    r"{need}\b<40>\b{sponsorship}\b<60>\b{not}(?: be)? {done}\b",  # requiring sponsorship will not be considered
    r"no (?:{kind} )*(?:{sponsorship}|{visa} {help})\b(?! (?:is )?(?:required|needed|necessary|fees?|costs?))",  # no future sponsorship
    r"without(?: (?:the|a|any|need|for|of|now|in|{kind}))* {sponsorship}\b",
    r"(?:not {open}|ineligible) (?:for|to)\b<60>\b(?:{sponsorship}|{visa} support)",
    r"must not\b<40>\b{need}\b<40>\b{sponsorship}\b",
    r"unrestricted (?:work|employment) authorization\b",
]
NAMED_OFFERS = [r"{who} (?:will )?sponsor\b<40>\bh-?1b", r"h-?1b (?:transfer )?{sponsorship} (?:is )?(?:available|supported)\b"]
OFFERS = [r"visa {sponsorship} (?:is )?available\b", r"{who} (?:will |do )?sponsor\b<40>\b(?:{permit}|visas?)\b"]


def role_signal(text: Column) -> Column:
    """A refusal outranks an offer for one visa class, which outranks a general offer."""
    says = lambda rules: reduce(or_, [matches(text, rule(r)) for r in rules])
    return F.when(says(REFUSALS), "explicit_no_sponsorship").when(says(NAMED_OFFERS), "explicit_h1b_sponsorship_available").when(says(OFFERS), "explicit_sponsorship_available").otherwise("not_stated")


def role_score(signal: Column, employer: Column) -> Column:
    return F.when(signal == "explicit_no_sponsorship", 0.0).when(signal == "explicit_h1b_sponsorship_available", F.greatest(F.lit(0.92), employer)).when(signal == "explicit_sponsorship_available", F.greatest(F.lit(0.58), employer)).otherwise(employer)


def employer_score(confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EMPLOYER_SCORES.items() for x in kv])
    key = F.replace(F.replace(F.lower(confidence), F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(table, key), F.lit(EMPLOYER_SCORES["historical"]))


def rubric(records: DataFrame, employer: str, certified: Column, relevant: Column, changes: Column, high: tuple[int, int] = (100, 20), medium: tuple[int, int] = (20, 5)) -> DataFrame:
    """Employer confidence from its filings: (employer, certified, relevant, changes, confidence).

    high and medium: least certified records, least relevant ones; high also needs a change of employer.
    """
    n = records.groupBy(employer).agg(F.count_if(certified).alias("certified"), F.count_if(certified & relevant).alias("relevant"), F.coalesce(F.sum(F.when(certified, changes)), F.lit(0)).alias("changes"))
    level = F.when((F.col("certified") >= high[0]) & (F.col("relevant") >= high[1]) & (F.col("changes") > 0), "high").when((F.col("certified") >= medium[0]) & (F.col("relevant") >= medium[1]), "medium").otherwise("low")
    return n.withColumn("confidence", level)
