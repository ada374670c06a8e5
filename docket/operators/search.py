"""Substring search and rule tables over names, by an index of grams: short pieces of text and the names that hold them.

A search, or a pattern that cannot match without some run of letters, is looked up under the rarest of its grams, and what is
found is verified. So many searches meet many names in joins on grams, never every search with every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.rules import RULE_FIELDS, SCOPES, Rule, first_rule, rule_texts
from docket.functions.names import py

GRAM = 3
CELL = 4096  # searches, and files found, of one text that meet in one cell


def grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a text; none when it is shorter."""
    length = F.char_length(text)
    at = F.when(length >= size, F.sequence(F.lit(1), length - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))


def rarest(asked: DataFrame, posted: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """(by, place, gram): for each ``by`` of ``asked`` (by, place, gram) the gram that stands in the fewest rows of ``posted``
    (place, gram, ...)."""
    held = posted.groupBy(*place, "gram").agg(F.count(F.lit(1)).alias("held"))
    counted = asked.join(held, [*place, "gram"], "left")
    return counted.groupBy(*by, *place).agg(F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)), "gram")).alias("gram"))


def search_names(filings: DataFrame, queries: DataFrame, cell: int = CELL) -> DataFrame:
    """Case-insensitive substring searches (query_id unique, report_id, query), any number per report; a null report searches
    all. One row per search and file found. A null query finds nothing, an empty one every name.

    Names are listed under their pieces of up to three characters that are asked for. A search of three characters and more goes
    by its rarest piece, a shorter one is a piece itself, and the empty text is a piece of every name. What is asked many times in
    a report is looked up and verified once. Its searches and the files it finds are then dealt into cells of about ``cell`` by
    ``cell``, so that the rows of one text asked often, which are searches times files, are made by many tasks. A cell's rows come
    file by file, all searches after one another, so columns of a file are long runs and take next to no room where they are
    written."""
    needle = F.lower("query")
    asked = queries.select("query_id", F.col("report_id").alias("within"), "query", needle.alias("needle")).filter("needle IS NOT NULL")
    searches = asked.groupBy("within", "needle").agg(F.count(F.lit(1)).alias("searches"))
    pieces = F.when(F.char_length("needle") >= GRAM, grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    wanted = searches.select("needle").distinct().select("needle", F.explode(pieces).alias("gram"))
    text = F.lower("original_filename")
    every = F.concat(F.array(F.lit("")), *[grams(text, n) for n in range(1, GRAM + 1)])
    names = filings.filter("original_filename IS NOT NULL").select(
        "report_id", "doc_id", "original_filename", "category", "page_count", "is_included"
    )
    posted = names.withColumn("gram", F.explode(every)).join(wanted.select("gram").distinct(), "gram", "left_semi")
    chosen = searches.join(rarest(wanted, posted, ["needle"], []), "needle")
    # Exploded rows look fewer to Spark than they are, so these joins are told not to broadcast.
    one = chosen.filter("within IS NOT NULL").alias("chosen").join(
        posted.alias("posted").hint("merge"), (F.col("within") == F.col("report_id")) & (F.col("chosen.gram") == F.col("posted.gram"))
    )
    everywhere = chosen.filter("within IS NULL").alias("chosen").join(posted.alias("posted").hint("merge"), F.col("chosen.gram") == F.col("posted.gram"))
    columns = ["within", "needle", "searches", *names.columns]
    found = one.select(*columns).union(everywhere.select(*columns)).filter(text.contains(F.col("needle")))

    same = _both("asked", "found")
    files = found.groupBy("within", "needle").agg(F.count(F.lit(1)).alias("files"))
    parts = lambda n: F.ceil(F.col(n) / cell)
    part = lambda key, n: F.pmod(F.xxhash64(key), parts(n))
    every_part = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    counted = asked.alias("asked").join(searches.alias("counts"), _both("asked", "counts")).join(files.alias("found"), same)
    left = counted.select("asked.*", part("query_id", "searches").alias("a"), every_part("files").alias("b"))
    sized = found.alias("asked").join(files.alias("found"), same)
    right = sized.select("asked.*", "files").select("*", part("doc_id", "files").alias("b"), every_part("searches").alias("a"))
    met = right.alias("found").join(left.alias("asked").hint("merge"), same & (F.col("asked.a") == F.col("found.a")) & (F.col("asked.b") == F.col("found.b")))
    return met.select(
        "query_id", "query", "report_id", "doc_id", "original_filename", "category", "page_count", "is_included"
    )


def _both(one: str, other: str) -> Column:
    return F.col(f"{one}.within").eqNullSafe(F.col(f"{other}.within")) & (F.col(f"{one}.needle") == F.col(f"{other}.needle"))


def run_finder(shortest: int = GRAM):
    """A function that travels with the job, so workers need no copy of this package."""

    def required(pattern: str) -> str | None:
        """The longest run of characters that every match of a pattern holds, None where no run of ``shortest`` is certain. A
        pattern that this Python cannot read, or that ignores case, has none."""
        import re

        try:
            parsed = re._parser.parse(pattern)
        except (re.error, OverflowError, RecursionError):
            return None
        if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
            return None
        runs = [""]
        for kind, value in parsed:
            if str(kind) == "LITERAL":
                runs[-1] += chr(value)
            elif str(kind) != "AT":  # an anchor stands between characters
                runs.append("")
        longest = max(runs, key=len)
        return longest if len(longest) >= shortest else None

    return required


required = run_finder()


def _listed(text: str) -> Column:
    return F.transform(grams(F.col(text), GRAM), lambda gram: F.struct(F.lit(text).alias("kind"), gram.alias("gram")))


def match_rules(df: DataFrame, table: DataFrame, name: str, path: str, size: str | None, prefix: str) -> DataFrame:
    """Add the fields of the first rule of ``table`` that matches, by ``prio`` and then by scope and pattern.

    Rules whose pattern holds a required run are listed under the rarest of its grams and meet the names that hold it; each such
    pair is verified, and the least rule kept. Only rules without a run are compiled into a column expression. Each distinct
    file name and path is looked up once."""
    keys = [name, path, *([size] if size else [])]
    own = {k: f"__own_{i}" for i, k in enumerate(keys)}
    files = df.select(*[F.col(k).alias(own[k]) for k in keys]).distinct()
    files = files.withColumns(rule_texts(own[name], own[path], own[size] if size else None))

    find = run_finder()
    rules = table.select(*Rule._fields).withColumn("run", F.pandas_udf(lambda patterns: patterns.map(find, na_action="ignore"), "string")("pattern"))
    run = F.when(F.col("pattern") != "", F.col("run"))
    kind = F.lit(None).cast("string")
    for scope, (_, text) in SCOPES.items():
        kind = F.when(F.col("scope") == scope, F.lit(text)).otherwise(kind)
    indexed = rules.withColumns({"run": run, "kind": kind}).filter("run IS NOT NULL").withColumn("rule", F.struct(*Rule._fields))
    texts = sorted({text for _, text in SCOPES.values()})
    listed = F.flatten(F.array(*map(_listed, texts)))
    wanted = indexed.select("rule", "kind", F.explode(grams(F.col("run"), GRAM)).alias("gram"))
    posted = files.select(*own.values(), F.explode(listed).alias("at")).select(*own.values(), "at.kind", "at.gram")
    posted = posted.join(wanted.select("kind", "gram").distinct(), ["kind", "gram"], "left_semi")
    chosen = rarest(wanted, posted, ["rule"], ["kind"])
    same = F.lit(True)
    for k in own.values():
        same = same & F.col(f"files.{k}").eqNullSafe(F.col(f"met.{k}"))
    met = posted.join(chosen, ["kind", "gram"]).select(*own.values(), "rule")
    pairs = files.alias("files").join(met.alias("met"), same).select("files.*", "met.rule")
    fits = F.lit(False)
    for scope, (which, text) in SCOPES.items():
        fits = fits | ((F.col("rule.scope") == scope) & F.expr(which) & F.rlike(F.col(text), F.concat(F.lit(py("")), F.col("rule.pattern"))))
    found = pairs.filter(fits).groupBy(*own.values()).agg(F.min("rule").alias("__indexed"))

    plain = rules.withColumn("run", run).filter("run IS NULL").drop("run")
    rest = sorted((Rule(*row) for row in plain.toLocalIterator()), key=lambda r: (r.prio, r.scope, r.pattern))
    best = files.select(*own.values(), first_rule(rest).alias("__plain")).alias("files")
    same = F.lit(True)
    for k in own.values():
        same = same & F.col(f"files.{k}").eqNullSafe(F.col(f"found.{k}"))
    both = best.join(found.alias("found"), same, "left").select("files.*", F.least("found.__indexed", "files.__plain").alias("__rule"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"df.{k}").eqNullSafe(F.col(f"both.{own[k]}"))
    joined = df.alias("df").join(both.alias("both"), same, "left")
    return joined.select("df.*", *[F.col(f"both.__rule.{f}").alias(f"{prefix}{f}") for f in RULE_FIELDS])
