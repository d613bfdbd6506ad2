"""Operator 1, URL filters: association rules over URL tokens.

Listed rules (a host with its subdomains, and a path prefix) judge the URLs that they fit. Those
verdicts are the labels from which FP-growth mines combinations of URL tokens; rules
"tokens, hence verdict" that pass the support and confidence bounds judge the other URLs through an
inverted index. Only DataFrame and Spark ML functions are used.

A URL has at most ``FAMILIES`` tokens, one for each family (scheme, top-level domain, site,
subdomain, first directory, leaf with its numbers masked, extension, depth, query keys, fragment), each
computed from the whole URL. So a labelled URL has at most 2**FAMILIES combinations, and at most
2**FAMILIES / min_support combinations can be frequent, whatever the number of rows: the rules have a
proven bound and may be broadcast.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no listed
rule, has no token and gets the default verdict. Of listed rules that fit, the longest counts. Of mined rules that
match, the most confident counts, then the one with more support, fewer tokens, the verdict ``block``,
the later text. Repeated rows are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctra.llm.common import materialise

FAMILIES = 10
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.02, 0.8, 3
ALLOW, BLOCK = "allow", "block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; nulls if none does."""
    rule = verdict = None
    for text in sorted(rules, key=lambda x: (-len(x), x)):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, rules[text]) if verdict is None else verdict.when(fits, rules[text])
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """At most one token of each family."""
    host, path, rest = host_of(url), path_of(url), _rest(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    depth = F.size(parts)
    leaf = F.try_element_at(parts, F.lit(-1))
    ext = F.regexp_extract(leaf, r"\.([A-Za-z0-9]+)$", 1)
    keys = F.array_sort(F.array_distinct(F.transform(F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])))
    query = F.array_join(keys, "&")
    every = [
        F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)),
        F.when(host != "", F.concat(F.lit("tld:"), F.element_at(labels, -1))),
        F.when(n >= 2, F.concat(F.lit("site:"), F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1))),
        F.when(n >= 3, F.concat(F.lit("sub:"), F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))), "."))),
        F.when(depth >= 2, F.concat(F.lit("dir:"), F.get(parts, F.lit(0)))),
        F.when(depth >= 1, F.concat(F.lit("leaf:"), F.regexp_replace(leaf, "[0-9]+", "#"))),
        F.when(ext != "", F.concat(F.lit("ext:"), ext)),
        F.concat(F.lit("depth:"), depth.cast("string")),
        F.when(query != "", F.concat(F.lit("query:"), query)),
        F.when(F.instr(rest, "#") > 0, F.lit("fragment:")),
    ]
    return F.when(F.instr(url, "://") > 0, F.array_compact(F.array(*every))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules from ``url`` and ``verdict``: key (rarest token), tokens, verdict, confidence, support."""
    items = F.array_append(tokens_of(F.col("url")), F.concat(F.lit("verdict:"), F.col("verdict")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled.select(items.alias("items")))
    to = F.col("consequent")[0]
    rules = model.associationRules.where(to.startswith("verdict:") & (F.size("antecedent") <= max_tokens))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring_index(to, ":", -1).alias("verdict"), "confidence", "support")
    rules = materialise(rules.withColumn("key", F.array_join("tokens", " ")), "url-rules")
    rarity = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    postings = rules.select("key", F.explode("tokens").alias("token")).join(rarity, "token").groupBy("key").agg(F.min(F.struct("freq", "token")).alias("rarest"))
    return materialise(rules.join(postings, "key").withColumn("token", F.col("rarest.token")).drop("rarest"), "url-index")


def judge(urls: DataFrame, rules: dict[str, str], default: str = ALLOW, url: str = "url", **bounds) -> DataFrame:
    """Adds to each row struct ``judged``: host, path, rule, verdict, and the tokens, confidence and support of a mined rule.

    Struct ``row`` holds the columns that came in.
    """
    u = F.col(f"row.`{url}`")
    host, path = F.coalesce(host_of(u), F.lit("")), F.coalesce(path_of(u), F.lit(""))
    rows = urls.select(F.struct("*").alias("row")).withColumn("id", F.monotonically_increasing_id()).withColumn("host", host).withColumn("path", path)
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)
    index = mine(rows.where("rule IS NOT NULL").select(u.alias("url"), F.col("listed").alias("verdict")), **bounds)
    # Bounded by 2**FAMILIES / min_support, see above.
    index = F.broadcast(index.select("token", F.col("tokens").alias("needs"), F.col("verdict").alias("mined"), "confidence", "support", "key"))
    rows = rows.withColumn("tokens", F.when(F.col("rule").isNull(), F.coalesce(tokens_of(u), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    found = rows.withColumn("token", F.explode_outer("tokens")).join(index, "token", "left")
    fits = F.col("needs").isNotNull() & (F.size(F.array_except("needs", "tokens")) == 0)
    best = F.when(fits, F.struct("confidence", "support", (-F.size("needs")).alias("shortness"), "mined", "key"))
    carried = [F.first(c).alias(c) for c in ("row", "host", "path", "rule", "listed")]
    found = found.groupBy("id").agg(*carried, F.max(best).alias("best"))
    return found.select(
        "row",
        F.struct(
            "host", "path", "rule", F.coalesce("listed", "best.mined", F.lit(default)).alias("verdict"),
            F.col("best.key").alias("tokens"), F.col("best.confidence").alias("confidence"), F.col("best.support").alias("support"),
        ).alias("judged"),
    )


def sql(rules: dict[str, str], default: str = ALLOW) -> str:
    """DuckDB form of the query over pages (unique page_ids)."""
    cases = lambda out: "CASE " + " ".join(
        f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{out(t)}'" for t in sorted(rules, key=lambda x: (-len(x), x))
    ) + " END"
    return rf"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {cases(lambda t: t)} AS rule, {cases(lambda t: rules[t])} AS listed, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x != '') AS parts,
      list_sort(list_distinct(list_transform(string_split(regexp_extract(rest, '\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)))) AS keys FROM b),
d AS (SELECT page_id, host, path, rule, listed, CASE WHEN instr(url, '://') > 0 THEN list_filter([
        'scheme:' || split_part(url, '://', 1), CASE WHEN host != '' THEN 'tld:' || labels[-1] END, CASE WHEN len(labels) >= 2 THEN 'site:' || labels[-2] || '.' || labels[-1] END,
        CASE WHEN len(labels) >= 3 THEN 'sub:' || array_to_string(labels[1:len(labels) - 2], '.') END, CASE WHEN len(parts) >= 2 THEN 'dir:' || parts[1] END,
        CASE WHEN len(parts) >= 1 THEN 'leaf:' || regexp_replace(parts[-1], '[0-9]+', '#', 'g') END, CASE WHEN regexp_extract(parts[-1], '\.([A-Za-z0-9]+)$', 1) != '' THEN 'ext:' || regexp_extract(parts[-1], '\.([A-Za-z0-9]+)$', 1) END,
        'depth:' || len(parts), CASE WHEN array_to_string(keys, '&') != '' THEN 'query:' || array_to_string(keys, '&') END, CASE WHEN instr(rest, '#') > 0 THEN 'fragment:' END], lambda x: x IS NOT NULL) ELSE [] END AS tokens FROM c),
t AS (SELECT page_id, listed, rule, unnest(tokens) AS token FROM d),
s AS (SELECT page_id, listed, rule, [token] AS k FROM t
      UNION ALL SELECT x.page_id, x.listed, x.rule, [x.token, y.token] FROM t x JOIN t y ON x.page_id = y.page_id AND x.token < y.token
      UNION ALL SELECT x.page_id, x.listed, x.rule, [x.token, y.token, z.token] FROM t x JOIN t y ON x.page_id = y.page_id AND x.token < y.token JOIN t z ON x.page_id = z.page_id AND y.token < z.token),
n AS (SELECT count(*) AS n FROM d WHERE rule IS NOT NULL),
f AS (SELECT k, count(*) AS m, count(*) FILTER (listed = '{ALLOW}') AS allow_n, count(*) FILTER (listed = '{BLOCK}') AS block_n FROM s WHERE rule IS NOT NULL GROUP BY k),
g AS (SELECT k, m, '{ALLOW}' AS mined, allow_n AS c FROM f UNION ALL SELECT k, m, '{BLOCK}', block_n FROM f),
h AS (SELECT k, mined, c::DOUBLE / m AS confidence, c::DOUBLE / n.n AS support FROM g, n WHERE c >= greatest(ceil({MIN_SUPPORT} * n.n), 1) AND c::DOUBLE / m >= {MIN_CONFIDENCE}),
w AS (SELECT s.page_id, h.*, row_number() OVER (PARTITION BY s.page_id ORDER BY confidence DESC, support DESC, len(h.k), mined DESC, array_to_string(h.k, ' ') DESC) AS r
      FROM s JOIN h ON s.k = h.k WHERE s.rule IS NULL)
SELECT d.page_id, d.host, d.path, d.rule, coalesce(d.listed, w.mined, '{default}') AS verdict, array_to_string(w.k, ' ') AS tokens
FROM d LEFT JOIN w ON w.page_id = d.page_id AND w.r = 1
"""
