"""URL filters: fixed rules, and a path-template tree that judges the rest by labelled purity.

Per host the path's segments form a tree. Runs of digits become ``*``; a segment value that has
little support under its node becomes ``*`` whole; a branch whose share of bad labels does not
differ from its siblings' by a two-proportion test is merged with them into ``*``. Of the branches
that do differ, those worse than their siblings are compared with one another, and so are the better
ones: what does not differ there is merged into ``{+}`` or ``{-}``. A page's template is what remains, with ``**`` for the rest of a path below a node where no branch can stay, at
whatever depth that is; pages of one template whose rests have as many segments are judged together, and blocked if their smoothed share of bad pages reaches
a limit. Each level is one aggregation and one join with the few branches that stay.

A page's label is that of the document whose number ends its path; a document is bad if its
quality is 0 or it is toxic. A number beyond 64 bits is no document's.

Defined results: a null url, or one without ``://``, has an empty host and path, which form a
template of their own; null and repeated page_ids stay as rows of their own; a document with
several labels is bad if one says so; null labels say nothing; other columns are ignored; empty
tables give an empty table or no labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import join_counted, stored, table

#: (rule, verdict): host, then path; a rule fits its host and all subdomains, the longest wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Ends the template of a path that is not followed to its end.
REST = "**"
#: Stands for the segment of a path that has no further one; no segment has this value.
END = "/"
#: Pages that a branch needs to stay; the test's critical value.
MIN_PAGES, CRITICAL = 20, 1.96
#: Names of merged branches that are worse, and better, than their siblings.
WORSE, BETTER = "{+}", "{-}"
#: Levels that ``OP8_SQL`` follows; the operator follows open nodes to any depth, which a fixed number of SQL steps can't.
SQL_DEPTH = 9
NUMBER = "(?:^|[^0-9])([0-9]{1,19})[^0-9/]*/?$"
#: Pages of the overall share that are added to each template; share of bad pages from which it is blocked.
PRIOR_PAGES, BLOCKED_SHARE = 10, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts() -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of the column ``url``."""
    url = F.col("url")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def differs(n_bad: Column, n: Column, all_bad: Column, all_n: Column) -> Column:
    """Two-proportion test of a branch against its siblings."""
    share = all_bad / all_n
    z = (n_bad / n - (all_bad - n_bad) / (all_n - n)) / F.sqrt(share * (1 - share) * (1 / n + 1 / (all_n - n)))
    return F.when((n > 0) & (all_n > n) & (all_bad > 0) & (all_bad < all_n), F.abs(z) >= CRITICAL).otherwise(False)


def named(branches: DataFrame) -> DataFrame:
    """template, value, kept: of branches that stay the name that each takes.

    ``branches`` has template, value, n, n_bad and, of the node, all_n and all_bad.
    """
    rows = branches.withColumn("side", F.when(F.col("n_bad") * F.col("all_n") > F.col("all_bad") * F.col("n"), WORSE).otherwise(BETTER)).drop("all_n", "all_bad")
    pools = rows.groupBy("template", "side").agg(F.sum("n").alias("all_n"), F.sum("n_bad").alias("all_bad"))
    rows = rows.join(pools, ["template", "side"]).withColumn("alike", ~differs(F.col("n_bad"), F.col("n"), F.col("all_bad"), F.col("all_n")))
    merged = rows.groupBy("template", "side").agg(F.count_if("alike").alias("merged"))
    name = F.when(F.col("alike") & (F.col("merged") > 1), F.col("side")).otherwise(F.col("value"))
    return rows.join(merged, ["template", "side"]).select("template", "value", name.alias("kept"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, rest, bad_share of every page; ``rest`` is how many segments ``**`` stands for."""
    host, path = parts()
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad")
    )
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "doc_id", F.expr(f"try_cast(nullif(regexp_extract(path, '{NUMBER}', 1), '') AS bigint)")
    )
    rows = stored(rows, "pages")
    # Pages without a number need no label, and a number that many pages end in is broadcast with its label.
    numbered = rows.where("doc_id is not null")
    asked = stored(numbered.groupBy("doc_id").agg(F.count("*").alias("n")).join(bad, "doc_id", "left"), "asked-labels")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    columns = ["page_id", "host", "path", "bad", F.col("host").alias("template")]
    rows = join_counted(numbered, asked, "doc_id", total).select(columns).unionByName(
        rows.where("doc_id is null").withColumn("bad", F.lit(None).cast("int")).select(columns)
    )
    rows = stored(rows, "labelled-pages")
    segments = F.when(F.col("path") != "", F.size(F.split(F.substring("path", 2, 1 << 30), "/"))).otherwise(0)
    ended, depth = None, 0
    while True:
        value = F.get(F.split(F.regexp_replace(F.substring("path", 2, 1 << 30), "[0-9]+", "*"), "/"), F.lit(depth))
        rows = rows.withColumn("value", F.coalesce(F.when(F.col("path") != "", value), F.lit(END)))
        branches = rows.groupBy("template", "value").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
        branches = stored(branches, "branches")
        going = F.col("value") != END
        nodes = branches.groupBy("template").agg(
            *[F.coalesce(F.sum(F.when(going, F.col(c))), F.lit(0)).alias(f"all_{c[2:] if c == 'n_bad' else c}") for c in ("pages", "n", "n_bad")]
        )
        # Below a node with too few pages, or with labels of one kind only, no branch can stay at any depth.
        open_ = (F.col("all_pages") >= MIN_PAGES) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_n"))
        nodes = stored(nodes.where(open_), "open-nodes")
        stays = (F.col("pages") >= MIN_PAGES) & differs(F.col("n_bad"), F.col("n"), F.col("all_bad"), F.col("all_n"))
        kept = stored(named(branches.where(going).join(nodes, "template").where(stays)), "kept-branches")
        # What becomes of each branch: one row per branch, which says how many pages it has.
        grown = F.when(~going, F.col("template")).when(F.col("open"), F.concat("template", F.lit("/"), F.coalesce("kept", F.lit("*")))).otherwise(F.concat("template", F.lit("/" + REST)))
        table = (
            branches.join(nodes.select("template", F.lit(True).alias("open")), "template", "left")
            .join(kept, ["template", "value"], "left")
            .withColumn("open", F.coalesce("open", F.lit(False)))
            .select("template", "value", F.col("pages").alias("n"), grown.alias("grown"), (going & F.col("open")).alias("goes_on"))
        )
        table, total = stored(table, "grown-branches"), branches.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
        rows = join_counted(rows, table, ["template", "value"], total)
        rows = stored(rows.select("page_id", "host", "path", "bad", F.col("grown").alias("template"), "goes_on"), "templates")
        over = rows.where(~F.col("goes_on")).drop("goes_on").withColumn("rest", F.greatest(segments - depth, F.lit(0)).cast("long"))
        ended = over if ended is None else ended.unionByName(over)
        if nodes.isEmpty():
            break
        rows, depth = rows.where("goes_on").drop("goes_on"), depth + 1
    rows = stored(ended, "ended") if depth else ended
    purity = stored(rows.groupBy("template", "rest").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")), "purity")
    n_bad, n, total = purity.agg(F.sum("n_bad"), F.sum("n"), F.coalesce(F.sum("pages"), F.lit(0))).first()
    share = (F.col("n_bad") + PRIOR_PAGES * F.lit(n_bad / n if n else 0.0)) / (F.col("n") + PRIOR_PAGES)
    purity = purity.select("template", "rest", F.col("pages").alias("n"), share.alias("bad_share"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    return join_counted(rows, purity, ["template", "rest"], total).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("bad_share") >= BLOCKED_SHARE, "block").otherwise("allow")).alias("verdict"),
        "template", "rest", F.round("bad_share", 6).alias("bad_share"),
    )


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    fits = lambda text: f"((host = '{text[: text.index('/')]}' OR ends_with(host, '.{text[: text.index('/')]}')) AND starts_with(path, '{text[text.index('/') :]}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for t, v in ordered) + " END"
    differs = (
        "CASE WHEN n > 0 AND all_n > n AND all_bad > 0 AND all_bad < all_n THEN abs((n_bad::DOUBLE / n - (all_bad - n_bad)::DOUBLE / (all_n - n)) / "
        f"sqrt((all_bad::DOUBLE / all_n) * (1 - all_bad::DOUBLE / all_n) * (1::DOUBLE / n + 1::DOUBLE / (all_n - n)))) >= {CRITICAL}::DOUBLE ELSE false END"
    )
    steps = rf"""
WITH bads AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
parted AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rows0 AS (
  SELECT page_id, host, path, bad, host AS template, 0::BIGINT AS rest, false AS ended FROM parted
  LEFT JOIN bads ON bads.doc_id = try_cast(nullif(regexp_extract(path, '{NUMBER}', 1), '') AS BIGINT))"""
    for k in range(SQL_DEPTH):
        # A path ends where it has no further segment, or at a node where no branch can stay.
        open_ = f"all_pages >= {MIN_PAGES} AND all_bad > 0 AND all_bad < all_n"
        stops = f"o.template IS NULL OR {str(k == SQL_DEPTH - 1).lower()}"
        steps += f""",
values{k} AS (
  SELECT *, CASE WHEN NOT ended AND path <> '' THEN string_split(regexp_replace(path[2:], '[0-9]+', '*', 'g'), '/')[{k + 1}] END AS value FROM rows{k}),
branches{k} AS (
  SELECT template, value, count(*) AS pages, count(bad) AS n, coalesce(sum(bad), 0) AS n_bad FROM values{k} WHERE value IS NOT NULL GROUP BY template, value),
nodes{k} AS (
  SELECT * FROM (SELECT template, sum(pages) AS all_pages, sum(n) AS all_n, sum(n_bad) AS all_bad FROM branches{k} GROUP BY template) WHERE {open_}),
stay{k} AS (
  SELECT b.*, CASE WHEN n_bad * all_n > all_bad * n THEN '{WORSE}' ELSE '{BETTER}' END AS side FROM branches{k} b JOIN nodes{k} USING (template) WHERE pages >= {MIN_PAGES} AND {differs}),
alike{k} AS (
  SELECT *, NOT ({differs}) AS alike FROM (
    SELECT *, sum(n) OVER (PARTITION BY template, side) AS all_n, sum(n_bad) OVER (PARTITION BY template, side) AS all_bad FROM stay{k})),
kept{k} AS (
  SELECT template, value, CASE WHEN alike AND count(*) FILTER (alike) OVER (PARTITION BY template, side) > 1 THEN side ELSE value END AS kept FROM alike{k}),
rows{k + 1} AS (
  SELECT page_id, host, path, bad, v.ended OR v.value IS NULL OR {stops} AS ended, CASE WHEN v.value IS NOT NULL AND ({stops}) THEN len(string_split(path[2:], '/')) - {k} ELSE v.rest END AS rest,
         CASE WHEN v.value IS NULL THEN v.template WHEN {stops} THEN v.template || '/{REST}' ELSE v.template || '/' || coalesce(k.kept, '*') END AS template
  FROM values{k} v LEFT JOIN nodes{k} o ON v.template = o.template LEFT JOIN kept{k} k ON v.template = k.template AND v.value = k.value)"""
    return (
        steps
        + f""",
purity AS (SELECT template, rest, count(bad) AS n, coalesce(sum(bad), 0) AS n_bad FROM rows{SQL_DEPTH} GROUP BY template, rest),
shares AS (
  SELECT template, rest, (n_bad + {PRIOR_PAGES} * (SELECT coalesce(sum(n_bad)::DOUBLE / sum(n), 0) FROM purity)) / (n + {PRIOR_PAGES}) AS bad_share FROM purity)
SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN bad_share >= {BLOCKED_SHARE}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       template, rest, round(bad_share, 6) AS bad_share
FROM rows{SQL_DEPTH} JOIN shares USING (template, rest)
"""
    )


OP8_SQL = _sql()
