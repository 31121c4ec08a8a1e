"""What a docket's titles and dates say: event kinds, versions of one event, stays, exits, schedules and deadlines.

documents: case_id, id, document_type, title, day, public. Titles are told apart by tables of patterns; everything that
goes by days is an aggregate of days, so that no case is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.similarity import token_set_ratio
from lodestar.operators.graph import components
from lodestar.operators.resolve import candidate_pairs

# Types of what a tribunal issues, and patterns of titles.
ISSUED = ("Order", "Order, Commission", "Notice", "ID/RD - Other Than Final on Violation")
REPRINT = r"(?i)^\s*f\.\s*r\.\s"
INSTITUTION = r"(?i)notice\s+of\s+institution|institution\s+of\s+(?:the\s+)?investigation"
ID_ISSUED = r"(?i)initial\s+determination\s+on\s+violation"
ERRATA = r"(?i)\berrat"
SD = r"(?i)summary\s+determination"
REMAND = r"(?i)\bremand"
DEFAULT = r"(?i)\bdefault"
TERMINATION = r"(?i)\bterminat|\bwithdraw|\bsettle|consent\s+order|\barbitration"
NOT_FINAL_ID = r"(?i)^\s*recommended\s+determination|\badvisory\b"
NOT_TO_REVIEW, TO_REVIEW = r"(?i)\bnot\s+to\s+review\b", r"(?i)\bto\s+review\b"
DISPOSITIVE = r"(?i)\bterminat|\bwithdraw|\bsettle|consent\s+order|\bdefault|summary\s+determination|final\s+initial|violation|\bremand|\barbitration|\brescind|\brescission"
DETERMINATION = (
    r"(?i)final\s+determination|determination\s+to\s+terminate|terminat\w*\s+the\s+investigation|finding\s+(?:a\s+|no\s+)?violation"
    r"|\bremand|\breverse|\baffirm|\brescind|\brescission|issuance\s+of\s+(?:an?\s+)?(?:limited|general)"
)
ORDER = r"(?i)exclusion\s+order|cease\s+and\s+desist|consent\s+order|\bremand|\brevers|\brescission|\brescind|\bmodif"
HOUSEKEEPING = (
    r"(?i)target\s+date|\bextend|deadline|\bschedul|declassif|redact|investigative\s+attorney|early\s+(?:adjudication|disposition)"
    r"|protective\s+order|errata|ground\s+rules|\bstay\b|\bstaying\b|public\s+interest\s+(?:comments|submissions)"
)
VARIANT = (
    r"\[?\bcorrected\b\]?|\bpublic\s+version\b|\bconfidential\b|\(public\)|\[dkt[^\]]*\]|\[motion\s+docket[^\]]*\]"
    r"|order\s+no\.?\s*\d+\s*:?|[^a-z0-9 ]"
)
_NUMBERED = r"^\W*(?:order\s+no\.?\s*\d+\s*:?\s*)?"
STAY = r"(?i)\bstay(?:s|ing|ed)?\b"
DENIED = rf"(?i){_NUMBERED}(?:\(\d+\)\s*)?denying\b"
LIFTED = r"(?i)\b(?:lift(?:s|ing)?|dissolv\w*|terminat\w*|end(?:s|ing)?|vacat\w*)\s+(?:the\s+)?stay\b"
STAYED_AS_TO = r"(?i)\bstay\w*\b.*?\b(?:as\s+to|with\s+respect\s+to)\s+(.+?)(?:\s+pending\b|\s*;|\s*\[|\s*\(\d|$)"
UNTIL = r"\b(?i:until)\s+([A-Z][a-z]+\.?\s+\d{1,2},?\s+\d{4})"
FOR_DAYS = r"(?i)\bfor\s+([\w-]+)\s+days\b"
NUMBERS = {"seven": 7, "ten": 10, "fourteen": 14, "fifteen": 15, "twenty": 20, "twenty-one": 21, "thirty": 30, "forty-five": 45, "sixty": 60, "ninety": 90}
RESCHEDULED = r"(?i)(?:setting|amending|modifying|revis\w*|adopt\w*|resum\w*)\s+(?:the\s+)?(?:amended\s+|revised\s+)?procedural\s+schedule|procedural\s+schedule\W*$"
TERMINATED_AS_TO = (
    r"(?i)terminat\w*\s+(?:the\s+)?investigation\s+(?:in\s+part\s+)?(?:as\s+to|with\s+respect\s+to)\s+"
    r"(.+?)(?:\s+(?:based|on\s+the\s+basis|pursuant|due|by\s+reason)\b|\s+and\s+(?:limiting|stay\w*|amend\w*|modif\w*|granting|denying|setting|extending)\b|\s*;|\s*\[|\s*\(\d|$)"
)
FOUND_IN_DEFAULT = r"(?i)finding\s+(.+?)\s+in\s+default\b"
VAGUE = r"(?i)^(?:a|an|one|two|three|four|five|several|certain|all|the)?\s*(?:(?:remaining|defaulting)\s+)?respondents?(?:\s+groups?)?$"
NOT_A_PARTY = r"(?i)\bclaims?\b|\bpatents?\b|'\d{3}\b|\bU\.?S\.?\s+Pat"
GENERIC = "certain respondent respondents the and inc ltd llc corp co company corporation limited group technology technologies international america".split()
SCHEDULE = r"(?i)procedural\s+schedule|target\s+date|ground\s+rules|schedule\s+for\s+filing|written\s+submissions"
NOT_SETTING = rf"(?i){_NUMBERED}(?:seeking|requesting|regarding\s+the\s+parties|denying)\b|\bseeking\s+(?:a\s+)?(?:joint\s+)?(?:submission|statement)|\bjoint\s+statement\b|returned\s+mail|{_NUMBERED}(?:joint\s+)?proposed\s+procedural\s+schedule"
FULL_SCHEDULE = rf"(?i)(?:setting|sets|issuing|adopting)\s+(?:the\s+|a\s+)?(?:revised\s+|amended\s+)?procedural\s+schedule|{_NUMBERED}adopted\s+procedural\s+schedule|{_NUMBERED}(?:revised\s+|amended\s+)?procedural\s+schedule\W*$|order\s+setting\s+(?:the\s+)?procedural\s+schedule"
TARGET, NOT_TARGET_ONLY = r"(?i)target\s+date", r"(?i)procedural\s+schedule|schedule\s+for\s+filing|written\s+submissions"

#: How documents tell their kind: (type, title must match, title must not match, kind), the first row that holds. No type
#: means any; no kind means none.
OTHER_ID, FINAL_ID, COMMISSION = "ID/RD - Other Than Final on Violation", "ID/RD - Final on Violation", "Order, Commission"
KINDS = (
    (None, (REPRINT,), (), None),
    ("Notice", (INSTITUTION,), (), "institution"),
    ("Notice", (ID_ISSUED, ERRATA), ("(?i)commission",), None),
    ("Notice", (ID_ISSUED,), ("(?i)commission",), "final_id"),
    ("Notice", (HOUSEKEEPING,), (), None),
    (COMMISSION, (HOUSEKEEPING,), (), None),
    (OTHER_ID, (SD,), (), "summary_determination"),
    (OTHER_ID, (REMAND,), (ERRATA,), "remand_id"),
    (OTHER_ID, (DEFAULT,), (), "default"),
    (OTHER_ID, (TERMINATION,), (), "termination"),
    (FINAL_ID, (), (NOT_FINAL_ID, ERRATA), "final_id"),
    ("Notice", (NOT_TO_REVIEW, DISPOSITIVE), (), "not_reviewed"),
    ("Notice", (NOT_TO_REVIEW,), (), None),
    ("Notice", (TO_REVIEW, DISPOSITIVE), (), "review"),
    ("Notice", (DETERMINATION,), (), "determination"),
    ("Notice", (DISPOSITIVE,), (), "determination"),
    (COMMISSION, (ORDER,), (), "order"),
    ("Opinion, Commission", (), (), "opinion"),
)
#: Days within which documents of a kind may be versions of one event, and how alike their titles must be.
WINDOWS, WINDOW, ALIKE = {"final_id": 120}, 60, 96.0


def _title() -> Column:
    return F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))


def kind_of(title: Column, document_type: Column) -> Column:
    out = F.when(title == "", F.lit(None).cast("string"))
    for type_, needs, lacks, kind in KINDS:
        holds = F.lit(True) if type_ is None else document_type == type_
        for pattern in needs:
            holds = holds & title.rlike(pattern)
        for pattern in lacks:
            holds = holds & ~title.rlike(pattern)
        out = out.when(holds, F.lit(kind).cast("string"))
    return out


def bare_title(title: Column) -> Column:
    """The title without what sets versions apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), VARIANT, " "), r"\s+", " "))


def title_classes(titles: DataFrame) -> DataFrame:
    """bare -> title_class: titles that are alike, directly or through others, share a class."""
    names = titles.select("bare").distinct()
    pairs = candidate_pairs(names.withColumnRenamed("bare", "key"), ALIKE).select("a", "b")
    return components(names.withColumnRenamed("bare", "node"), pairs).select(F.col("node").alias("bare"), F.col("component").alias("title_class"))


def anchored(rows: DataFrame, by: list[str], window: Column) -> DataFrame:
    """rows (day) with `first_day`: the day that begins the run a row is in. A run takes the days up to `window` days after
    its first; the next day begins another. What is folded is a group's distinct days, never its rows."""
    days = rows.groupBy(*by).agg(F.array_sort(F.collect_set(F.unix_date("day"))).alias("days"), F.max(window).alias("w"))
    firsts = F.aggregate("days", F.array().cast("array<int>"), lambda acc, d: F.when((F.size(acc) > 0) & (d - F.element_at(acc, -1) <= F.col("w")), acc).otherwise(F.concat(acc, F.array(d))))
    runs = days.select(*by, F.explode(firsts).alias("first"), "w")
    both = rows.withColumn("d", F.unix_date("day")).join(runs, by).filter(F.col("d").between(F.col("first"), F.col("first") + F.col("w")))
    return both.withColumn("first_day", F.date_from_unix_date("first")).drop("d", "first", "w")


def versions(documents: DataFrame) -> DataFrame:
    """case_id, kind, day, first_id, link, versions (how many): one row an event.

    Documents of a kind are versions of one event within its window of days if their titles are alike (a final ID's
    whatever they say). The event has its first version's day and links the latest public one, for a final ID rather
    the decision than a notice of it; without a public one the first."""
    rows = documents.withColumn("title", _title()).withColumn("kind", kind_of(F.col("title"), F.col("document_type"))).filter("kind IS NOT NULL AND day IS NOT NULL")
    rows = rows.withColumn("bare", F.when(F.col("kind").isin(*WINDOWS), "").otherwise(bare_title(F.col("title"))))
    rows = rows.join(title_classes(rows), "bare")
    window = F.lit(WINDOW)
    for kind, days in WINDOWS.items():
        window = F.when(F.col("kind") == kind, days).otherwise(window)
    runs = anchored(rows, ["case_id", "kind", "title_class"], window)
    best = F.struct(F.when(F.col("kind") == "final_id", F.col("document_type") != "Notice").otherwise(True).alias("itself"), "day", "id")
    found = runs.groupBy("case_id", "kind", "title_class", "first_day").agg(
        F.min(F.struct("day", "id")).alias("first"), F.max(F.when(F.col("public"), best)).alias("shown"), F.count(F.lit(1)).alias("versions"))
    return found.select("case_id", "kind", F.col("first.day").alias("day"), F.col("first.id").alias("first_id"), F.coalesce("shown.id", "first.id").alias("link"), "versions")


# ---- stays and exits


def issued(documents: DataFrame) -> DataFrame:
    return documents.withColumn("title", _title()).filter(F.col("document_type").isin(*ISSUED) & F.col("day").isNotNull() & ~F.startswith("title", F.lit("F.R.")))


def until_of(title: Column, day: Column) -> Column:
    """The end a title names: until a date, or for so many days."""
    date = F.regexp_replace(F.regexp_extract(title, UNTIL, 1), "[.,]", "")
    word = F.lower(F.regexp_extract(title, FOR_DAYS, 1))
    number = F.coalesce(word.try_cast("int"), F.element_at(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv]), word))
    named = F.coalesce(F.try_to_date(F.nullif(date, F.lit("")), "MMMM d yyyy"), F.try_to_date(F.nullif(date, F.lit("")), "MMM d yyyy"))
    return F.coalesce(named, F.when(number > 0, F.date_add(day, number)))


def _who(title: Column, pattern: str) -> Column:
    """The party a title names, without "the certain respondents" before it; null for none."""
    found = F.regexp_replace(F.regexp_extract(title, pattern, 1), r"^[ .,:]+|[ .,:]+$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r"(?i)^(?:the\s+)?(?:certain\s+)?respondents?\s+", ""), r"^[ .,:]+|[ .,:]+$", ""), F.lit(""))


def _stays(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stays with who they are for and until when, the other orders that matter to them) of documents."""
    rows, title = issued(documents), F.col("title")
    stays = rows.filter(title.rlike(STAY) & ~title.rlike(DENIED) & ~title.rlike(LIFTED)).select("case_id", "id", "day", _who(title, STAYED_AS_TO).alias("who"), until_of(title, F.col("day")).alias("until"))
    other = F.when(title.rlike(LIFTED), "lifted").when(title.rlike(RESCHEDULED) & ~title.rlike(STAY), "rescheduled")
    return stays, rows.select("case_id", "day", other.alias("what")).filter("what IS NOT NULL")


def whole_stays(documents: DataFrame, today: str) -> DataFrame:
    """case_id, since, until, extended, active, ended: the latest stay of the whole case.

    It began with the first stay that no lifting separates from the latest; it ends when lifted, when its end has
    passed, or when a later order sets the schedule again."""
    stays, others = _stays(documents)
    whole = stays.filter("who IS NULL")
    latest = whole.groupBy("case_id").agg(F.max_by(F.struct(F.col("day").alias("latest"), "until"), F.struct("day", "id")).alias("s")).select("case_id", "s.*")
    after = others.join(latest.select("case_id", "latest"), "case_id").groupBy("case_id").agg(
        F.max(F.when((F.col("what") == "lifted") & (F.col("day") <= F.col("latest")), F.col("day"))).alias("before"),
        F.max((F.col("what") == "lifted") & (F.col("day") >= F.col("latest"))).alias("lifted"), F.max((F.col("what") == "rescheduled") & (F.col("day") > F.col("latest"))).alias("again"))
    known = latest.join(after, "case_id", "left")
    run = whole.select("case_id", "day").join(known, "case_id").filter(F.col("before").isNull() | (F.col("day") >= F.col("before")))
    told = run.groupBy("case_id", "latest", "until", "lifted", "again").agg(F.min("day").alias("since"), (F.count(F.lit(1)) > 1).alias("extended"))
    ended = F.when(F.col("lifted"), F.lit("lifted")).when(F.col("until") < F.lit(today).cast("date"), F.concat(F.lit("ran to "), F.col("until").cast("string"))).when(F.col("again"), F.lit("a later order set the schedule again"))
    return told.select("case_id", "since", "until", "extended", ended.isNull().alias("active"), ended.alias("ended"))


def partial_stays(documents: DataFrame, today: str, gone: DataFrame | None = None) -> DataFrame:
    """case_id, who, since, until: the latest order for each respondent that is neither lifted nor run out. gone: exits
    (case_id, who); a stay for one who left the case goes."""
    stays, others = _stays(documents)
    lifts = others.filter("what = 'lifted'").groupBy("case_id").agg(F.max("day").alias("lift"))
    live = stays.filter("who IS NOT NULL").join(lifts, "case_id", "left").filter(F.col("lift").isNull() | (F.col("lift") < F.col("day"))).filter(F.col("until").isNull() | (F.col("until") >= F.lit(today).cast("date")))
    last = live.groupBy("case_id", "who").agg(F.max_by(F.struct(F.col("day").alias("since"), "until"), F.struct("day", "id")).alias("s")).select("case_id", "who", "s.*")
    if gone is None:
        return last
    loose = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = gone.select("case_id", loose(F.col("who")).alias("name"))
    met = last.withColumn("loose", loose(F.col("who"))).join(names, "case_id").filter(F.col("loose").contains(F.col("name")) | F.col("name").contains(F.col("loose"))).select("case_id", "who").distinct()
    return last.join(met, ["case_id", "who"], "left_anti")


def final_exits(documents: DataFrame, days: int = 90) -> DataFrame:
    """case_id, id, who, how, day, final: respondents terminated or in default, by the first document that names each.

    An exit is final if a notice of the Commission names it, or if within the days after it a notice not to review an
    exit follows, whoever that names. Names that name nobody, and claims or patents, are no respondents."""
    rows, title = issued(documents), F.col("title")
    commission = (F.col("document_type") == "Notice") & F.lower("title").contains("not to review")
    named = rows.filter(~title.rlike(DENIED)).withColumn("commission", commission)
    ways = [named.filter(title.rlike(p)).select("case_id", "id", "day", "commission", F.lit(how).alias("how"), _who(title, p).alias("who")) for p, how in ((TERMINATED_AS_TO, "terminated"), (FOUND_IN_DEFAULT, "in default"))]
    each = ways[0].unionByName(ways[1])
    reviews = each.filter("commission").groupBy("case_id").agg(F.array_sort(F.collect_set("day")).alias("reviews"))  # distinct days
    real = each.filter(F.col("who").isNotNull() & ~F.col("who").rlike(VAGUE) & ~F.col("who").rlike(NOT_A_PARTY) & (F.length("who") <= 160))
    key = F.regexp_replace(F.lower("who"), "[^a-z0-9]", "")
    first = real.groupBy("case_id", key.alias("key")).agg(F.min(F.struct("day", "id", "who", "how")).alias("x"), F.max("commission").alias("said"))
    found = first.select("case_id", "x.*", "said").join(reviews, "case_id", "left")
    late = F.exists(F.coalesce("reviews", F.array().cast("array<date>")), lambda d: F.datediff(d, F.col("day")).between(0, days))
    return found.select("case_id", "id", "who", "how", "day", (F.col("said") | late).alias("final"))


def distinctive(name: Column) -> Column:
    """The first word of a party's name that tells it from others; null for none."""
    return F.get(F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC)), 0)


def without_exited(events: DataFrame, exits: DataFrame) -> DataFrame:
    """Scheduled events (case_id, label, basis) but those an order set that name a respondent out of the case (exits:
    case_id, who), told by the first distinctive word of its name."""
    gone = exits.select("case_id", distinctive(F.col("who")).alias("word")).filter("word IS NOT NULL").distinct()
    said = events.filter("basis = 'order'").select("case_id", "label").distinct().withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("label"), F.lit("[a-z0-9]+"), F.lit(0)))))
    about = said.join(gone, ["case_id", "word"]).select("case_id", "label", F.lit("order").alias("basis")).distinct()
    return events.join(about, ["case_id", "label", "basis"], "left_anti")


#: Which milestones of the case record stand for an order's dates: category, words the name must and must not have, and
#: how the milestone's label begins.
MILESTONES = (
    ("target_date", "", "", "Target date"),
    ("hearing", "evidentiary hearing", r"pre-?hearing|brief|statement", "Evidentiary hearing"),
    ("claim_construction", "hearing", "", "Markman (claim construction) hearing"),
    ("initial_determination", "", "", "Final initial determination on violation (scheduled)"),
)


def with_schedule(milestones: DataFrame, schedule: DataFrame) -> DataFrame:
    """case_id, label, date, basis: the case record's milestones (case_id, label, date), and the schedule's dates
    (case_id, event, category, date) but those of which the record has a milestone, which wins."""
    name, out = F.lower("event"), F.lit(None).cast("string")
    for category, needs, lacks, label in reversed(MILESTONES):
        stands = (F.col("category") == category) & name.contains(needs)
        out = F.when(stands & ~name.rlike(lacks) if lacks else stands, F.lit(label)).otherwise(out)
    begins = F.lit(None).cast("string")
    for *_, label in MILESTONES:
        begins = F.when(F.startswith("label", F.lit(label)) if label == "Target date" else F.col("label") == label, F.lit(label)).otherwise(begins)
    have = milestones.select("case_id", begins.alias("stands")).filter("stands IS NOT NULL").distinct()
    left = schedule.withColumn("stands", out).join(have, ["case_id", "stands"], "left_anti")
    return milestones.select("case_id", "label", "date", F.lit("case data").alias("basis")).unionByName(left.select("case_id", F.col("event").alias("label"), "date", F.lit("order").alias("basis")))


def schedule_documents(documents: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """Documents that set dates and are worth reading: from the latest full schedule on, and of those that only move the
    target date the latest. since: case_id, since, the final ID's day, from which on alone documents count."""
    title = F.col("title")
    found = issued(documents).filter(F.col("public") & title.rlike(SCHEDULE) & ~title.rlike(NOT_SETTING)).withColumn("target", title.rlike(TARGET) & ~title.rlike(NOT_TARGET_ONLY))
    if since is not None:
        found = found.join(since, "case_id", "left")
    else:
        found = found.withColumn("since", F.lit(None).cast("date"))
    base = F.max(F.when(title.rlike(FULL_SCHEDULE), F.col("day"))).over(Window.partitionBy("case_id"))
    kept = found.withColumn("base", base).filter(F.when(F.col("since").isNotNull(), F.col("day") >= F.col("since")).otherwise(F.col("base").isNull() | (F.col("day") >= F.col("base")) | F.col("target")))
    last = F.row_number().over(Window.partitionBy("case_id", "target").orderBy(F.desc("day"), F.desc("id")))
    return kept.withColumn("last", last).filter("NOT target OR last = 1").select(*documents.columns, "target")


# ---- schedules

#: Words that tell two events of one category apart, and those that say nothing.
CONTRAST = frozenset(
    "initial opening rebuttal reply responsive response responses supplemental first second third final tentative proposed direct joint pre post prehearing "
    "posthearing fact expert begins ends start end complainant complainants respondent respondents staff".split()
)
PLAIN = frozenset("the a an and of to for on in with by any all file serve parties party deadline date including their its".split())


def event_words(name: str) -> frozenset[str]:
    return frozenset("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split()) - PLAIN


def same_event(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """(category, name) pairs that mean one event: same category, and one's words within the other's or nearly so."""
    x, y = event_words(a[1]), event_words(b[1])
    if a[0] != b[0] or (x ^ y) & CONTRAST:
        return False
    return bool(x and y) and (x <= y or y <= x or token_set_ratio(" ".join(sorted(x)), " ".join(sorted(y))) >= 90)


@dataclass
class Overlay:
    """Schedule orders of one case, laid over each other in their order."""

    events: list[dict] = field(default_factory=list)

    def lay(self, order: list[dict]) -> None:
        """An order that restates the schedule (at least as many events, most of them met) replaces it; another
        replaces the events it names and adds the rest."""
        met = [e for e in self.events if any(same_event((e["category"], e["event"]), (n["category"], n["event"])) for n in order)]
        if self.events and len(order) >= 5 and len(met) * 2 >= len(self.events):
            self.events = []
        for n in order:
            at = next((i for i, e in enumerate(self.events) if same_event((e["category"], e["event"]), (n["category"], n["event"]))), None)
            if at is None:
                self.events.append(n)
            else:
                self.events[at] = n | {"replaces": self.events[at]["date"]}


def overlay(orders: DataFrame) -> DataFrame:
    """orders: case_id, doc_id, day, events (array of event, date, end_date, category) -> the schedule as it stands."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        laid = Overlay()
        for o in group.sort_values(["day", "doc_id"]).itertuples():
            laid.lay([{"case_id": o.case_id, "doc_id": o.doc_id, **{k: e[k] for k in ("event", "date", "end_date", "category")}, "replaces": None} for e in o.events])
        return pd.DataFrame(laid.events, columns=["case_id", "doc_id", "event", "date", "end_date", "category", "replaces"])

    return orders.groupBy("case_id").applyInPandas(run, "case_id string, doc_id string, event string, date date, end_date date, category string, replaces date")


def upcoming(events: DataFrame, today: str, stays: DataFrame | None = None, days: int = 35) -> DataFrame:
    """Events (case_id, label, date) of the next days, nearest first in each case, those of stayed cases left out."""
    now = F.lit(today).cast("date")
    live = events.filter(F.col("date").between(now, F.date_add(now, days)))
    if stays is not None:
        live = live.join(stays.filter("active").select("case_id"), "case_id", "left_anti")
    order = Window.partitionBy("case_id").orderBy("date", "label")
    return live.withColumn("turn", F.row_number().over(order)).withColumn("days_left", F.datediff("date", now))


def stage_of(facts: DataFrame, calendar: DataFrame, today: str, quiet_days: int = 730) -> DataFrame:
    """facts: case_id, open, withdrawn, status, phase, received, start, target, final_id, reviewed, not_reviewed, extended,
    determination (title), determined, latest -> case_id, stage and the next rule deadline.

    Pre-institution cases wait 30 days for a decision; after a final ID petitions are due in 12 days, responses 8 after
    that, and a decision on review in 60; a determination with a remedy goes to the President for 60."""
    from lodestar.operators.calendar import period_end

    low = F.lower(F.coalesce("determination", F.lit("")))
    decided = F.col("determined").isNotNull() & (F.col("determined") >= F.col("final_id"))
    remedy, none = low.rlike("exclusion order|cease and desist|remedial"), low.rlike("no violation|terminat")
    stage = (
        F.when(~F.col("open") | F.coalesce("withdrawn", F.lit(False)), F.lit(None).cast("string")).when(F.col("status") == "Pre-institution", "pre_institution").when(F.col("phase") != "Violation", "other")
        .when(F.coalesce("start", "target", "final_id").isNull(), "undated").when(F.col("final_id").isNull(), "alj").when(decided & remedy, "presidential").when(decided & none, "concluded").otherwise("commission")
    )
    out = facts.withColumn("stage", stage)
    event = F.when(F.col("stage") == "pre_institution", F.col("received")).when(F.col("stage") == "presidential", F.col("determined")).when(F.col("stage") == "commission", F.col("final_id"))
    waiting = F.coalesce(F.col("reviewed"), F.col("not_reviewed")).isNull()
    days = F.when(F.col("stage") == "pre_institution", 30).when(F.col("stage") == "presidential", 60).when((F.col("stage") == "commission") & waiting & ~F.coalesce("extended", F.lit(False)), 60)
    dated = period_end(out.withColumn("_e", event).withColumn("_d", days), calendar, "_e", "_d", "due")
    petitions = period_end(dated.withColumn("_p", F.when(F.col("stage") == "commission", F.col("final_id"))).withColumn("_n", F.lit(12)), calendar, "_p", "_n", "petitions_due")
    responses = period_end(petitions.withColumn("_m", F.lit(8)), calendar, "petitions_due", "_m", "responses_due")
    idle = F.datediff(F.lit(today).cast("date"), "latest") > quiet_days
    return responses.select("case_id", F.when(F.col("stage").isNotNull() & F.coalesce(idle, F.lit(False)), "dormant").otherwise(F.col("stage")).alias("stage"), "due", "petitions_due", "responses_due")
