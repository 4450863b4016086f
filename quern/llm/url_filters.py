"""URL filters: suffix rules on host and path, and for the rest a logistic regression on hashed character n-grams.

Everything is DataFrame and SQL expressions.  The model is fitted on a small labelled table of URLs by gradient
ascent in its dual form: each labelled URL has one coefficient, and the inner products of the URLs' n-gram counts are
all that a step needs, so a fit is one expression over a few short arrays.  Scoring is a map over the pages with one
row of weights at hand (as many numbers as there are buckets, whatever the input), so no page is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the registered query: (host/path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A small labelled table: (url, 1 to block).
LABELLED = (
    ("http://news.example.net/en/2021/report", 0), ("https://www.library.example.net/en/catalogue/42", 0), ("https://blog.garden.example.net/en/7198", 0),
    ("http://www.museum.example.com/en/visit", 0), ("https://docs.tool.example.com/en/guide/install", 0), ("https://m.weather.example.net/fr/paris", 0),
    ("https://school.example.net/es/curso/lengua", 0), ("http://radio.example.net/de/programm", 0), ("https://wiki.example.com/en/history", 0),
    ("https://www.science.example.net/en/article/981", 0), ("http://recipes.example.com/es/sopa", 0), ("https://city.example.net/de/rathaus", 0),
    ("http://casino-bonus.example.com/win/jackpot", 1), ("https://free-pills.example.net/buy/cheap?ref=x", 1), ("http://xxx-cam.example.com/live/adult", 1),
    ("https://bet.example.net/poker/bonus", 1), ("http://download-crack.example.com/keygen.exe", 1), ("https://cheap-loans.example.net/apply/now", 1),
    ("http://clickbait.example.com/win/prize/free", 1), ("https://adult-dating.example.net/hot/xxx", 1), ("http://torrent.example.net/crack/serial", 1),
    ("https://replica-watch.example.com/buy/cheap", 1), ("http://spam.example.net/offer/free?ref=x", 1), ("https://jackpot.example.com/casino/slots", 1),
)
BUCKETS, SIZES, STEPS, RATE, DECAY = 4096, (3, 4), 200, 0.05, 0.001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(sizes: tuple[int, ...] = SIZES) -> str:
    """SQL for the buckets of all n-grams of column `place`: of `^host/path$`, so that ends count."""
    each = [f"if(length(place) >= {n}, transform(sequence(1, length(place) - {n - 1}), i -> substring(place, i, {n})), cast(array() as array<string>))" for n in sizes]
    return f"transform(concat({', '.join(each)}), g -> cast(conv(substring(md5(encode(g, 'UTF-8')), 1, 3), 16, 10) as int))"


def split_urls(pages: DataFrame) -> DataFrame:
    """Adds host, path and place (their text with marks at its ends)."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return out.withColumn("place", F.concat(F.lit("^"), "host", "path", F.lit("$")))


def fit(spark: SparkSession, labelled=LABELLED, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """One row with column w: a weight for each bucket, and last the bias.

    labelled: (url, 0 or 1) rows, a table small enough to be given in code; the fit is quadratic in its length.
    """
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, y double")
    counts = split_urls(rows).select("i", F.expr(f"explode({grams()})").alias("b")).groupBy("i", "b").agg(F.count("*").cast("double").alias("c"))
    ids = rows.select("i", "y")
    inner = counts.alias("p").join(counts.alias("q"), "b").groupBy(F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(F.sum(F.col("p.c") * F.col("q.c")).alias("v"))
    line = inner.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("v"))
    line = ids.join(line, "i", "left").select("i", "y", F.expr(f"transform(sequence(0, {len(labelled) - 1}), j -> 1D + coalesce(v[j], 0D))").alias("v"))
    one = line.agg(F.sort_array(F.collect_list(F.struct("i", "y", "v"))).alias("d"))
    one = one.select("d", F.expr("transform(d, e -> e.v)").alias("k")).repartition(1)  # one row; kept apart, or each step would compute k anew
    step = (
        "transform(a, (v, i) -> v + {r}D * (d[i].y - 1D / (1D + exp(-aggregate(zip_with(a, k[i], (p, q) -> p * q), 0D, (s, t) -> s + t)))) - {r}D * {l}D * v)"
    ).format(r=rate, l=decay)
    fitted = one.select("d", F.expr(f"aggregate(sequence(1, {steps}), transform(d, e -> 0D), (a, n) -> {step})").alias("a")).repartition(1)
    dual = fitted.select(F.explode(F.arrays_zip("d", "a")).alias("e")).select(F.col("e.d.i").alias("i"), F.col("e.a").alias("a"))
    part = dual.join(counts, "i").select("b", (F.col("a") * F.col("c")).alias("v"))
    weights = part.unionByName(dual.select(F.lit(BUCKETS).alias("b"), F.col("a").alias("v"))).groupBy("b").agg(F.sum("v").alias("v"))
    return weights.agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m")).select(F.expr(f"transform(sequence(0, {BUCKETS}), b -> coalesce(m[b], 0D))").alias("w"))


def rule_of(rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, rest = text.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = fits & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability to block) for each row of pages (page_id, url).

    Rows that repeat give repeated rows, a null or empty URL has empty host and path and is judged by the model's bias
    and the two end marks, an empty table gives an empty table, other columns are ignored.
    """
    rule, verdict = rule_of(rules)
    split = split_urls(pages.select("page_id", "url"))
    scored = split.withColumn("w", fit(pages.sparkSession, labelled).scalar())  # BUCKETS + 1 numbers
    logit = F.expr(f"w[{BUCKETS}] + aggregate({grams()}, 0D, (s, b) -> s + w[b])")
    out = scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), (1 / (1 + F.exp(-logit))).alias("score"))
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", model).alias("verdict"), "score")


def oracle() -> str:
    """DuckDB SQL for the registered query: the same fit as a recursive query of one row."""
    gram = " UNION ALL ".join(f"SELECT id, unnest(list_transform(range(1, len(place) - {n - 2}), lambda i: substr(place, i, {n}))) AS g FROM {{t}} WHERE len(place) >= {n}" for n in SIZES)
    bucket = "CAST('0x' || substr(md5(g), 1, 3) AS INTEGER)"
    cut = """SELECT id, host, path, '^' || host || path || '$' AS place{more} FROM (
      SELECT id, coalesce(translate(regexp_extract(rest, '(?s)\\A([^/?#]*)', 1), '%s', '%s'), '') AS host, coalesce(regexp_extract(rest, '(?s)\\A[^/?#]*([^?#]*)', 1), '') AS path{more}
      FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM {src}))""" % (UPPER, LOWER)
    urls = ", ".join(f"({i}, '{u}', {float(y)}::DOUBLE)" for i, (u, y) in enumerate(LABELLED))
    n = len(LABELLED)
    rule = verdict = ""
    for text, says in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, _, rest = text.partition("/")
        fits = f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{rest}') THEN "
        rule, verdict = rule + fits + f"'{text}' ", verdict + fits + f"'{says}' "
    return f"""WITH RECURSIVE t AS ({cut.format(more=', y', src=f"(VALUES {urls}) v(id, url, y)")}),
    x AS (SELECT id, {bucket} AS b, count(*)::DOUBLE AS c FROM ({gram.format(t='t')}) GROUP BY ALL),
    kk AS (SELECT p.id AS i, q.id AS j, 1.0 + coalesce(sum(x1.c * x2.c), 0) AS v FROM t p CROSS JOIN t q LEFT JOIN x x1 ON x1.id = p.id LEFT JOIN x x2 ON x2.id = q.id AND x2.b = x1.b GROUP BY ALL),
    rows AS (SELECT i, list(v ORDER BY j) AS v FROM kk GROUP BY i),
    one AS MATERIALIZED (SELECT list(v ORDER BY i) AS k, (SELECT list(y ORDER BY id) FROM t) AS y FROM rows),
    a AS (SELECT 0 AS n, list_transform(range({n}), lambda i: 0.0::DOUBLE) AS a UNION ALL
      SELECT n + 1, list_transform(range({n}), lambda i: a[i + 1] + {RATE}::DOUBLE * (y[i + 1] - 1 / (1 + exp(-list_dot_product(a, k[i + 1])))) - {RATE}::DOUBLE * {DECAY}::DOUBLE * a[i + 1]) FROM a, one WHERE n < {STEPS}),
    f AS (SELECT unnest(range({n})) AS id, unnest(a) AS a FROM a WHERE n = {STEPS}),
    w AS (SELECT b, sum(a * c) AS v FROM f JOIN x USING (id) GROUP BY b),
    p AS ({cut.format(more=', page_id', src="(SELECT row_number() OVER () AS id, page_id, url FROM pages)")}),
    s AS (SELECT id, sum(v) AS v FROM (SELECT id, {bucket} AS b FROM ({gram.format(t='p')})) JOIN w USING (b) GROUP BY id)
    SELECT page_id, host, path, CASE {rule}END AS rule, coalesce(CASE {verdict}END, CASE WHEN 1 / (1 + exp(-((SELECT sum(a) FROM f) + coalesce(s.v, 0)))) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN s USING (id)"""
