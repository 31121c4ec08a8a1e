"""What a summary of a case reads, what it costs, and the facts it must account for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.graph import components

#: Patterns of titles that decide what is read.
NOT_A_COMPLAINT = r"(?i)\bappendi(x|ces)\b|patent\s+papers|file\s+histor|certified\s+cop|\bletter\b|cover\s+sheet|certificate\s+of\s+service|\bconfidential\b|\bverification\b|\bproposed\b|\bpublic\s+interest\b"
AMENDED, SUPPLEMENT = r"(?i)\bamended\s+complaint\b", r"(?i)\bsupplement"
INSTITUTION = r"(?i)notice\s+of\s+institution|institution\s+of\s+(the\s+)?investigation"
REPRINT = r"(?i)^\s*f\.\s*r\.\s"
SD = r"(?i)summary\s+determination"
SD_MOTION = r"(?i)motions?\s+for\s+(?:a\s+)?(?:partial\s+)?summary\s+determination"
RULING_VERB = r"(?i)\b(?:granting|denying|dismissing)\b"
PROCEDURAL = r"(?i)extension|extend|\btime\b|\bleave\b|schedul|strike|\bbrief|page\s+limit|to\s+file|to\s+respond|oral\s+argument|withdraw\s+(?:its|the|their)\s+motion"
DENIAL = r"(?i)^\W*(?:\(\d+\)\s*)?(?:\[?corrected\]?\s*)?(?:public\s+version\s*)?(?:order\s+no\.?\s*\d+\s*:?\s*)?(?:initial\s+determ\w*\s+|id\s+)?(?:denying|dismissing)\b"
VARIANT = r"(?i)\[?\bcorrected\b\]?|\bpublic\s+version\b|\(public\)|order\s+no\.?\s*\d+\s*:?"
NOT_FINAL_ID = r"(?i)^\s*recommended\s+determination|\benforcement\b|\badvisory\b|\bmodification\b"
DECISION = r"(?i)final\s+determination|issuance\s+of\s+(?:an?\s+)?(?:limited|general)|finding\s+(?:a\s+|no\s+)?violation|termination\s+of\s+the\s+investigation\s+with"
MERITS = r"(?i)final\s+initial|summary\s+determination|violation|remand"
HOUSEKEEPING = r"(?i)\bextend|target\s+date|deadline|declassif|redact|public\s+version|investigative\s+attorney|schedul"
ANSWER = r"(?i)\b(?:response|answer)\b"
NOT_AN_ANSWER = r"(?i)\bexhibit|\bappendi|\bverification\b|certificate\s+of\s+service|\bletter\b|public\s+interest|\bdeclaration\b|\bconfidential\b|\berrata\b"
VERSION_DAYS = 45
SECTIONS = ("complaint", "answers", "rulings", "decisions")


def _first(rows: DataFrame, order: list[Column], read: Column, section: str, kind: str) -> DataFrame:
    """Rows of a section with a place in its order, and whether that place is read."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).withColumn("read", read).select("case_id", "id", F.lit(section).alias("section"), F.lit(kind).alias("kind"), "day", "read")


def answer_groups(answers: DataFrame) -> DataFrame:
    """node (case|id) -> component: answers of a case that share a firm or a respondent, directly or through others."""
    node = F.concat_ws("|", "case_id", "id")
    keys = answers.select(node.alias("node"), "case_id", F.explode(F.array(F.concat(F.lit("f:"), F.lower("firm")), F.concat(F.lit("r:"), F.lower("on_behalf_of")))).alias("k")).filter("k IS NOT NULL")
    hub = keys.groupBy("case_id", "k").agg(F.min("node").alias("a"))  # a star on each key, never all pairs
    edges = keys.join(hub, ["case_id", "k"]).select("a", F.col("node").alias("b"))
    return components(answers.select(node.alias("node")), edges)


def latest_versions(documents: DataFrame, days: int = VERSION_DAYS) -> DataFrame:
    """The latest of each document's versions: documents of a case with one title, but for what marks a version, whose
    days follow each other by at most so many."""
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace("title", VARIANT, " ")), r"\s+", " "))
    rows = documents.withColumn("bare", bare)
    by = Window.partitionBy("case_id", "bare").orderBy("day", "id")
    fresh = F.coalesce((F.datediff("day", F.lag("day").over(by)) > days).cast("int"), F.lit(1))
    runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.row_number().over(Window.partitionBy("case_id", "bare", "run").orderBy(F.desc("day"), F.desc("id")))
    return runs.withColumn("last", last).filter("last = 1").select(documents.columns)


def selection(documents: DataFrame, most_answers: int = 5, most_rulings: int = 10) -> DataFrame:
    """documents: case_id, id, document_type, title, security_level, day, firm, on_behalf_of -> what is read and what is
    left, by section: the latest amended complaint or the first, the notice of institution, the latest answer of each
    group, rulings on summary determination (grants first, newest first), the latest final ID, the Commission's
    notices on the merits, its last two opinions."""
    public = documents.filter("lower(security_level) = 'public'").withColumn("title", F.coalesce("title", F.lit("")))
    of = lambda *types: public.filter(F.col("document_type").isin(*types))
    title, age = F.col("title"), [F.col("day"), F.col("id")]
    newest = [F.desc("day"), F.desc("id")]
    body = of("Complaint").filter(title.rlike(r"(?i)\bcomplaint\b") & ~title.rlike(NOT_A_COMPLAINT))
    main = body.filter(~title.rlike(SUPPLEMENT))
    amended = title.rlike(AMENDED)
    parts = [_first(main, [F.desc(amended), F.when(amended, F.unix_date("day")).desc_nulls_last(), *age], F.col("place") == 1, "complaint", "complaint"), _first(body.filter(title.rlike(SUPPLEMENT)), age, F.lit(False), "complaint", "supplement")]
    parts.append(_first(of("Notice").filter(title.rlike(INSTITUTION) & ~title.rlike(REPRINT)), age, F.col("place") == 1, "complaint", "notice_of_institution").filter("read"))

    answers = of("Answer to Complaint").filter(title.rlike(ANSWER) & ~title.rlike(NOT_AN_ANSWER))
    grouped = answers.withColumn("node", F.concat_ws("|", "case_id", "id")).join(answer_groups(answers), "node")
    best = F.max_by(F.struct("id", "day"), F.struct(~title.rlike(SUPPLEMENT), F.col("day"), F.col("id")))
    groups = grouped.groupBy("case_id", "component").agg(best.alias("x"), F.min("day").alias("first")).select("case_id", "x.id", "x.day", "first")
    parts.append(_first(groups, [F.col("first"), F.col("id")], F.col("place") <= most_answers, "answers", "answer"))

    granted = (F.col("document_type") != "Order") | (title.rlike(SD_MOTION) & title.rlike(RULING_VERB))
    rulings = latest_versions(of("Order", "ID/RD - Other Than Final on Violation").filter(title.rlike(SD) & ~title.rlike(PROCEDURAL) & granted))
    parts.append(_first(rulings, [title.rlike(DENIAL), *newest], F.col("place") <= most_rulings, "rulings", "ruling"))
    parts.append(_first(latest_versions(of("ID/RD - Final on Violation").filter(~title.rlike(NOT_FINAL_ID))), newest, F.col("place") == 1, "decisions", "final_id"))
    notices = of("Notice").filter(~title.rlike(REPRINT) & ~title.rlike(HOUSEKEEPING) & title.rlike("(?i)commission") & ~title.rlike(r"(?i)\bnot\s+to\s+review\b"))
    parts.append(_first(notices.filter(title.rlike(DECISION) | (title.rlike(r"(?i)\bto\s+review\b") & title.rlike(MERITS))), age, F.lit(True), "decisions", "commission_notice"))
    parts.append(_first(latest_versions(of("Opinion, Commission")), newest, F.col("place") <= 2, "decisions", "commission_opinion"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SECTIONS) for x in (s, i)]), F.col("section"))
    return out.withColumn("turn", F.row_number().over(Window.partitionBy("case_id").orderBy(rank, "day", "id")))


def usage_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Dollars of each usage row (model, input, cache_write_5m, cache_write_1h, cache_read, output; tokens) at the
    model's rates (dollars a million tokens, same names)."""
    kinds = ("input", "cache_write_5m", "cache_write_1h", "cache_read", "output")
    priced = usage.join(F.broadcast(rates.select("model", *[F.col(k).alias(f"r_{k}") for k in kinds])), "model", "left")  # a price list
    return priced.withColumn("usd", sum((F.coalesce(k, F.lit(0)) * F.col(f"r_{k}") for k in kinds), F.lit(0.0)) / 1e6).drop(*[f"r_{k}" for k in kinds])


def estimate(read: DataFrame, pages: DataFrame, limits: dict[str, tuple[int, int]], per_page: int, prompt: int, notes_out: int, writer_in: int, writer_out: int, rates: tuple[float, float], writer_rates: tuple[float, float], spent: float, budget: float) -> DataFrame:
    """By case: pages read, dollars for notes and writing, and whether they exceed the budget. pages: id, pages; what is
    not counted yet is taken at its limit."""
    table = F.create_map(*[F.lit(x) for kind, (a, b) in limits.items() for x in (kind, a + b)])
    limit = F.coalesce(F.element_at(table, F.col("kind")), F.lit(10))
    lines = read.filter("read").join(pages, "id", "left").withColumn("n", F.least(F.coalesce("pages", limit), limit))
    usd = ((prompt + F.col("n") * per_page) * rates[0] + notes_out * rates[1]) / 1e6
    by = lines.groupBy("case_id").agg(F.sum("n").alias("pages_read"), F.count_if(F.col("pages").isNull()).alias("uncounted"), F.sum(usd).alias("notes_usd"), F.count(F.lit(1)).alias("lines"))
    total = by.withColumn("writer_usd", ((writer_in + F.col("lines") * notes_out) * writer_rates[0] + writer_out * writer_rates[1]) / 1e6)
    return total.withColumn("over_budget", F.col("notes_usd") + F.col("writer_usd") + spent > budget)


def claim_facts(events: DataFrame) -> DataFrame:
    """One fact for each action, patent, respondents and source, its claims as ranges."""
    ok = events.filter("status = 'ok'").withColumn("who", F.array_join(F.array_sort(F.coalesce("respondents", F.array(F.lit("ALL")))), ", "))
    grouped = ok.groupBy("case_id", "action", "patent", "who", "source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("claims")))).alias("claims"), F.min("date").alias("date"))
    runs = F.aggregate("claims", F.array().cast("array<struct<a:int,b:int>>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == x - 1), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), x.alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(x.alias("a"), x.alias("b"))))))
    text = F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string")))), ", ")
    named = F.when(F.size("claims") > 0, F.concat(F.when(F.size("claims") == 1, "claim ").otherwise("claims "), text)).otherwise(F.lit(""))
    return grouped.withColumn("text", named).withColumn("number", F.concat(F.lit("c"), F.row_number().over(Window.partitionBy("case_id").orderBy("date", "patent", "action", "who", "source")).cast("string")))
