"""Findings about duplicates: severity, folding, fallback, final order; context of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import impact, neighbours

# A finding in so many files or domains is that severe.
BANDS = ((5, "high", 3), (3, "medium", 2))
LEVELS = {"high": 3, "medium": 2, "low": 1}
CONFIDENCES = {"high": 4, "medium": 3, "low": 2, "refuted": 1}


def severity(files: Column, domains: Column) -> Column:
    """The higher of the bands of files and of domains."""
    most = F.greatest(files, domains)
    out = F.lit("low")
    for least, name, _ in reversed(BANDS):
        out = F.when(most >= least, name).otherwise(out)
    return out


def _level(of: Column, levels: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[of], F.lit(0))


def final_order(findings: DataFrame) -> DataFrame:
    """Findings by severity, confidence, rank and identity, named ov1, ov2 and so on. Findings are few: they are what a reader goes through."""
    w = Window.orderBy(F.desc(_level(F.col("severity"), LEVELS)), F.desc(_level(F.col("confidence"), CONFIDENCES)), F.desc("rank"), "identity")
    return findings.withColumn("id", F.concat(F.lit("ov"), F.row_number().over(w).cast("string")))


def folded(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, label_a, label_b, sim) of two labels the most similar (ties to smaller ids) with how many and which others it stands for."""
    key = [F.least("label_a", "label_b").alias("l1"), F.greatest("label_a", "label_b").alias("l2")]
    rank = F.struct((-F.col("sim")).alias("by"), "a", "b")
    g = pairs.groupBy(*key).agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("all"))
    more = F.array_except("all", F.array("first.a", "first.b"))
    return g.select("l1", "l2", F.col("first.a").alias("a"), F.col("first.b").alias("b"), (-F.col("first.by")).alias("sim"), (F.col("n") - 1).alias("folded"), F.array_join(more, ",").alias("more"))


def structural_confidence(members: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """M9: for groups (group, id, loc) whose bodies cannot be read: 2 points for a callee's label that all members which call anything share, if they are two at least; 1 for sizes alike (coefficient of variation below 0.4).

    high from 2 points on, medium at 1, else low.
    """
    size = F.col("loc").cast("decimal(12,0)")
    sums = members.groupBy("group").agg(F.countDistinct("id").alias("n"), F.count("loc").cast("decimal(12,0)").alias("k"), F.sum(size).alias("s"), F.sum(size * size).alias("q"))
    spread = (F.col("k") * F.col("q") - F.col("s") * F.col("s")).cast("decimal(38,0)")  # whole numbers: sums of floats depend on the rows' order, which decides groups that lie at the limit
    n = sums.select("group", "n", F.when(F.col("s") != 0, F.sqrt(spread.cast("double")) / F.col("s").cast("double")).otherwise(0.0).alias("cv"), F.coalesce((F.col("s") <= 0) | (25 * spread < 4 * F.col("s") * F.col("s")), F.lit(True)).alias("alike"))
    calls = members.join(edges.where("kind = 'call'").select(F.col("src").alias("id"), "dst"), "id").join(labels.select(F.col("id").alias("dst"), "label"), "dst").select("group", "id", "label").distinct()
    callers = calls.groupBy("group").agg(F.countDistinct("id").alias("callers")).where("callers >= 2")
    shared = calls.groupBy("group", "label").agg(F.count("*").alias("k")).join(callers, "group").where("k = callers").groupBy("group").agg(F.count("*").alias("shared"))
    score = F.when(F.col("shared") > 0, 2).otherwise(0) + F.when(F.col("alike"), 1).otherwise(0)
    out = n.join(shared, "group", "left").withColumn("shared", F.coalesce("shared", F.lit(0))).withColumn("score", score)
    return out.select("group", "n", "shared", F.round("cv", 9).alias("cv"), "score", F.when(F.col("score") >= 2, "high").when(F.col("score") == 1, "medium").otherwise("low").alias("confidence"))


def call_windows(callers: DataFrame, labels: DataFrame, around: int = 3, most: int = 8) -> DataFrame:
    """(id, start, end, calls): lines of each caller (id, line, text) around the first `most` lines that name one of the labels, overlapping and adjacent ones joined."""
    lines = callers.select("id", "line", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("at", "code"))
    words = lines.select("id", "line", "n", "at", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\w+"), F.lit(0)))).alias("label"))
    hits = words.join(labels.select("label").distinct(), "label", "left_semi").groupBy("id", "line", "n", "at").agg(F.lit(1))
    w = Window.partitionBy("id").orderBy("at")
    hits = hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    hit = F.col("line") + F.col("at")
    hits = hits.select("id", "at", hit.alias("hit"), F.greatest(F.col("line"), hit - around).alias("s"), F.least(F.col("line") + F.col("n") - 1, hit + around).alias("e"))
    gap = F.coalesce(F.col("s") > F.lag("e").over(w) + 1, F.lit(True)).cast("int")
    return hits.withColumn("gap", gap).withColumn("isle", F.sum("gap").over(w)).groupBy("id", "isle").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.array_join(F.array_sort(F.collect_list("hit")), ",").alias("calls")).drop("isle")


def context_pack(nodes: DataFrame, edges: DataFrame, ids: DataFrame, bodies: DataFrame, around: int = 3) -> DataFrame:
    """Q29: what an edit of the symbols needs: (section, id, start, end, calls). bodies: (id, line, text).

    target and callee: the node's lines; caller: its call windows (none: its
    lines, without calls); blast: everything its change reaches, ids only (lines 0).
    """
    span = lambda of, section: nodes.join(of, "id", "left_semi").select(F.lit(section).alias("section"), "id", F.col("line").alias("start"), (F.col("line") + F.greatest("loc", F.lit(1)) - 1).alias("end"), F.lit("").alias("calls"))
    callers = neighbours(edges, ids, "call")
    labels = nodes.join(ids, "id", "left_semi").select("label")
    windows = call_windows(bodies.join(callers, "id", "left_semi"), labels, around).select(F.lit("caller").alias("section"), "id", "start", "end", "calls")
    silent = span(callers.join(windows.select("id"), "id", "left_anti"), "caller")
    blast = impact(edges, ids).select(F.lit("blast").alias("section"), "id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("calls"))
    return span(ids, "target").union(windows).union(silent).union(span(neighbours(edges, ids, "call", False), "callee")).union(blast)


def _escaped(label: Column) -> Column:
    return F.regexp_replace(label, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def argument_count(call: Column) -> Column:
    """Arguments of the call whose bracket begins the text: commas at the top level and one, 0 where nothing but strings, brackets and space stands there; null if it does not end."""
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("depth", 0), ("commas", 0), ("some", False), ("quote", ""), ("last", ""), ("n", -1))])
    depth, over = (lambda a: a["depth"]), (lambda a: a["n"] >= 0)

    def step(a: Column, c: Column) -> Column:
        quoted, opens, shuts = a["quote"] != "", c.isin("(", "[", "{"), c.isin(")", "]", "}")
        plain = ~quoted & ~c.isin("'", '"', "`")
        now = F.when(plain & opens, depth(a) + 1).when(plain & shuts, depth(a) - 1).otherwise(depth(a))
        top = plain & ~opens & ~shuts & (depth(a) == 1)
        quote = F.when(~quoted & ~plain, c).when(quoted & (c == a["quote"]) & (a["last"] != "\\"), "").otherwise(a["quote"])
        n = F.when(plain & shuts & (now == 0), F.when(a["some"], a["commas"] + 1).otherwise(0)).otherwise(-1)
        new = F.struct(now.alias("depth"), (a["commas"] + F.when(top & (c == ","), 1).otherwise(0)).alias("commas"), (a["some"] | (top & (c != ",") & ~c.rlike(r"\s"))).alias("some"), quote.alias("quote"), c.alias("last"), n.alias("n"))
        return F.when(over(a), a).otherwise(new)

    n = F.aggregate(F.split(call, ""), start, step, lambda a: a["n"])
    return F.when(n >= 0, n)


def reliance(callers: DataFrame, most: int | None = None) -> DataFrame:
    """How callers rely on each symbol. callers: (id, label, caller, text), a symbol's callers with their bodies.

    Read off every line that calls the label, line comments aside: sites; how
    many await that call (or chain then, catch or finally); fields taken off
    its result, by name; the fewest and most arguments of calls that end on
    the line; sites inside a try of the same body or with catch chained on;
    sites that test the result for null. A call that spans lines counts
    without arguments. Symbols no line calls have no row. most: look at so
    many sites of a symbol, in the order of callers and lines; None: at all.
    """
    label = _escaped(F.col("label"))
    pattern = lambda before, after: F.concat(F.lit(before), label, F.lit(after))
    call, closed = r"\s*\(", r"\s*\([^()]*\)"
    body = Window.partitionBy("id", "caller").orderBy("line")
    lines = callers.select("id", "label", "caller", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    says = lambda *p: F.regexp_like("code", pattern(*p))
    # lines that neither call nor open or close a try change no sum, so they go before the rest moves; plain words are looked for first
    tried = F.contains("code", F.lit("try")) | F.contains("code", F.lit("catch")) | F.contains("code", F.lit("finally"))
    lines = lines.where(F.contains("code", "label") | tried).withColumn("code", F.when(F.contains("code", F.lit("//")), F.regexp_replace("code", r"(^|[^:])\/\/.*$", "$1")).otherwise(F.col("code")))
    step = F.when(tried, F.regexp_count("code", F.lit(r"\btry\s*\{")) - F.regexp_count("code", F.lit(r"\}\s*(?:catch|finally)\b"))).otherwise(0)
    lines = lines.select("*", step.alias("step"), (F.contains("code", "label") & says(r"\b", call)).alias("site")).where("site OR step <> 0")
    lines = lines.withColumn("sum", F.sum("step").over(body)).withColumn("low", F.least(F.min("sum").over(body), F.lit(0)))
    lines = lines.withColumn("tries", F.coalesce(F.lag(F.col("sum") - F.col("low")).over(body), F.lit(0)))  # opened and not closed before this line, never below 0
    sites = lines.where("site")
    if most is not None:
        sites = sites.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("caller", "line"))).where(F.col("r") <= most)
    # a line that stands in many places is read once
    sites = sites.groupBy("id", "label", "code", (F.col("tries") > 0).alias("tried")).agg(F.count("*").alias("n"))
    taken = pattern(r"(?:const|let|var)\s*\{([^}]*)\}\s*=\s*(?:await\s+)?[\w.$]*\b", call)
    names = F.transform(F.split(F.regexp_extract_all("code", taken, F.lit(1))[0], ","), lambda x: F.trim(F.split(F.trim(x), "[:=]")[0]))
    member = F.get(F.regexp_extract_all("code", pattern(r"\b", closed + r"\s*\.(\w+)"), F.lit(1)), 0)
    apart, chained = F.regexp_like("code", taken), F.coalesce(member.isin("then", "catch", "finally"), F.lit(False))
    fields = F.when(apart, F.filter(names, lambda x: (x != "") & ~x.startswith("..."))).when(member.isNotNull() & ~chained, F.array(member)).otherwise(F.array().cast("array<string>"))
    first = F.regexp_instr("code", pattern(r"\b", call))
    args = argument_count(F.regexp_replace(F.substring(F.col("code"), first, F.length("code")), r"^[^(]*", ""))
    null = says(r"\b", closed + r"\s*\?\.") | says(r"\b", closed + r"\s*\?\?") | says(r"\b", closed + r"\s*[!=]==?\s*(?:null|undefined)") | says(r"!\s*[\w.$]*\b", call)
    many = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return sites.groupBy("id").agg(
        F.sum("n").alias("n_sites"), many(says(r"\bawait\s+[\w.$]*\b", call) | (~apart & chained)).alias("awaited"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(fields)))), ",").alias("fields"), F.min(args).alias("least_args"), F.max(args).alias("most_args"),
        many(F.col("tried") | says(r"\b", closed + r"\s*\.catch\s*\(")).alias("handles_errors"), many(null).alias("null_checked"),
    )


#: Array methods that write to their array.
MUTATING = ("push", "pop", "shift", "unshift", "splice", "sort", "reverse", "fill", "copyWithin")


def mutated_parameters(symbols: DataFrame) -> DataFrame:
    """(id, param) for the parameters that a symbol's body writes through: a field or element set, Object.assign, a mutating method. symbols: (id, params array<string>, text)."""
    lines = symbols.select("id", F.explode("params").alias("param"), "text").withColumn("line", F.explode(F.split("text", "\n"))).withColumn("line", F.regexp_replace("line", r"(^|[^:])\/\/.*$", "$1"))
    p = _escaped(F.col("param"))
    says = lambda before, after: F.regexp_like("line", F.concat(F.lit(before), p, F.lit(after)))
    hit = says(r"\b", r"\s*(?:\.[\w$]+|\[[^\]]+\])\s*[+\-*/]?=(?!=)") | says(r"Object\.assign\(\s*", r"\b") | says(r"\b", rf"\s*(?:\.[\w$]+)*\.(?:{'|'.join(MUTATING)})\s*\(")
    return lines.where(hit).select("id", "param").distinct()
