"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batching, metrics, posterior, scoring, sequence
from ..operators.align import align_frames
from ..sources import manifest as M
from ..sources.manifest import shard

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(s, d):
    c = t(s, d, "conversations")
    ref = c.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), X.words(F.col("text")).alias("tokens"))
    hyp = c.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("id"), X.words(F.col("text")).alias("tokens"), "turn")
    return scoring.pairs(ref, hyp, "turn")


def probabilities(s, d):
    return t(s, d, "embeddings").select("vec_id", "label", posterior.softmax(F.transform("embedding", lambda x: x.cast("double") * 20)).alias("p"))


def neighbours(s, d):
    e = probabilities(s, d)
    return e.alias("a").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")


def sized(s, d):
    return t(s, d, "events").select("user_id", "ts", "event_id", (F.floor("value") % 50 + 1).cast("int").alias("size"))


_SOFT = "SELECT vec_id, label, list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) AS p FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * 20) AS e FROM embeddings)"
_NEAR = f"WITH e AS ({_SOFT}), n AS (SELECT a.vec_id, a.p, b.p AS q FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) "
_RUNS = """WITH f AS (SELECT user_id, event_type AS x, row_number() OVER w - 1 AS t, (lag(event_type) OVER w IS DISTINCT FROM event_type)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, x, t, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run, count(*) OVER (PARTITION BY user_id) AS n FROM f) """
_FOLD = """WITH RECURSIVE s AS (SELECT user_id, event_id, (floor(value) % 50 + 1)::INT AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, size, k, 0 AS batch, 1 AS n, size AS longest FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.event_id, s.size, s.k, CASE WHEN (r.n + 1) * greatest(r.longest, s.size) > 200 THEN r.batch + 1 ELSE r.batch END, CASE WHEN (r.n + 1) * greatest(r.longest, s.size) > 200 THEN 1 ELSE r.n + 1 END,
 CASE WHEN (r.n + 1) * greatest(r.longest, s.size) > 200 THEN s.size ELSE greatest(r.longest, s.size) END FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1) """
_WS = r"[ \t\n\r\f\x0b]+"
_LANG = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.LANGUAGES.items())
_CHAR = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{X.TOKEN}'), lambda x: regexp_replace(upper(replace(x, 'ß', 'ss')), '(?s)<[^>]*>?', '', 'g')), lambda x: x != '')"
_PAIRS = f"k AS (SELECT conv_id, turn, role, {_CHAR} AS w FROM conversations), q AS (SELECT r.conv_id || '-' || r.turn AS id, r.w AS ref, h.w AS hyp FROM k r JOIN k h ON r.conv_id = h.conv_id AND h.turn = r.turn + 1 WHERE r.role = 'user' AND h.role = 'assistant')"


def _edits(pairs: str) -> str:
    """SQL of the least edits of each pair: a row of the table a step, insertions as least values along the row."""
    return f"""WITH RECURSIVE {pairs}, d AS (SELECT id, ref, hyp, 0 AS i, list_transform(range(0, len(hyp) + 1), lambda x: x::BIGINT) AS row FROM q UNION ALL
    SELECT id, ref, hyp, i + 1, list_transform(range(0, len(hyp) + 1), lambda j: j + list_min(list_transform(up[1:j + 1], lambda x, m: x - (m - 1)))) FROM
    (SELECT id, ref, hyp, i, list_transform(range(0, len(hyp) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(row[j + 1] + 1, row[j] + (hyp[j] != ref[i + 1])::BIGINT) END) AS up FROM d WHERE i < len(ref))),
    e AS (SELECT id, len(ref)::INTEGER AS n, row[len(hyp) + 1]::INTEGER AS errors FROM d WHERE i = len(ref)) """


def _aligned(pairs: str) -> str:
    """SQL of the best alignment of each pair, its steps (r, h) in order: a row a cell, a line of the table a step, each with the path to it.

    A cell comes over a deletion if that is as good as any, else over an insertion, else over a pair; a path is a letter a step.
    """
    w = "(PARTITION BY id ORDER BY j)"
    return f"""WITH RECURSIVE {pairs}, m AS MATERIALIZED (SELECT * FROM q), l AS MATERIALIZED (SELECT id, unnest(ref) AS r, unnest(range(0, len(ref))) AS i FROM m),
    d AS (SELECT id, 0 AS i, j, h, j AS cost, repeat('I', j) AS path FROM (SELECT id, unnest(range(0, len(hyp) + 1)) AS j, unnest([''] || hyp) AS h FROM m) UNION ALL
    SELECT id, i + 1, j, h, new, last_value(CASE way WHEN 1 THEN path || 'D' WHEN 0 THEN before || 'P' END IGNORE NULLS) OVER {w} || repeat('I', j - max(CASE WHEN way != 2 THEN j END) OVER {w}) FROM
    (SELECT *, CASE WHEN new = cost + 1 THEN 1 WHEN j > 0 AND new = lag(new) OVER {w} + 1 THEN 2 ELSE 0 END AS way FROM
    (SELECT *, j + min(up - j) OVER {w} AS new FROM
    (SELECT d.*, lag(path) OVER (PARTITION BY d.id ORDER BY j) AS before, CASE WHEN j = 0 THEN d.i + 1 ELSE least(cost + 1, lag(cost) OVER (PARTITION BY d.id ORDER BY j) + (h != r)::BIGINT) END AS up FROM d JOIN l ON l.id = d.id AND l.i = d.i)))),
    a AS (SELECT id, ref, list_transform(range(1, len(path) + 1), lambda k: {{'r': CASE WHEN path[k] = 'I' THEN '' ELSE ref[len(replace(path[1:k], 'I', ''))] END, 'h': CASE WHEN path[k] = 'D' THEN '' ELSE hyp[len(replace(path[1:k], 'D', ''))] END}}) AS steps FROM d JOIN m USING (id) WHERE i = len(ref) AND j = len(hyp)),
    e AS (SELECT id, len(ref)::INTEGER AS n, len(list_filter(steps, lambda x: x.r = x.h))::INTEGER AS c, len(list_filter(steps, lambda x: x.r != '' AND x.h != '' AND x.r != x.h))::INTEGER AS s, len(list_filter(steps, lambda x: x.h = ''))::INTEGER AS d, len(list_filter(steps, lambda x: x.r = ''))::INTEGER AS i FROM a),
    tk AS (SELECT CASE WHEN x.r = '' THEN x.h ELSE x.r END AS token, count(*) FILTER (x.r != '') AS n, count(*) FILTER (x.r = x.h) AS c, count(*) FILTER (x.r != '' AND x.h != '' AND x.r != x.h) AS s, count(*) FILTER (x.h = '') AS d, count(*) FILTER (x.r = '') AS i FROM (SELECT unnest(steps) AS x FROM a) GROUP BY 1),
    ck AS (SELECT CASE WHEN regexp_matches(b, '^[0-9]+$') THEN 'Number' WHEN regexp_matches(b, '^[A-Za-zÀ-ÖØ-öø-ž]+$') THEN 'English' WHEN regexp_matches(b, '^[一-鿿]+$') THEN 'Mandarin' WHEN regexp_matches(b, '^[ぁ-ゖ]+$') THEN 'Japanese' ELSE 'Other' END AS cluster, n, c, s, d, i FROM (SELECT *, regexp_replace(token, '[&''@℃=._#+;-]', '', 'g') AS b FROM tk)) """


_SUMS = ", ".join(f"sum({x})::BIGINT AS {x}" for x in "ncsdi")
_WER = "CASE WHEN n > 0 THEN 100.0::DOUBLE * (s + d + i) / n ELSE 0 END"
_COUNTED = "' N=' || n || ' C=' || c || ' S=' || s || ' D=' || d || ' I=' || i"
_RATE = "round(CASE WHEN n > 0 THEN 100.0::DOUBLE * errors / n ELSE 0 END, 6) AS wer"
_DIGITS = "list_filter(w, lambda x: regexp_matches(x, '[0-9]'))"
_FRAMES = "f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, list_transform(p, lambda x: ln(greatest(x, 1e-12))) AS v FROM (%s)), c AS (SELECT label, count(*) AS n FROM f GROUP BY label)"


def _resampled(o: int, sizes: str) -> str:
    """SQL of the frames of label (key + o) % 10 at the lengths m of sizes (key, m)."""
    return f"""(SELECT key, t, list_transform(e, lambda x: greatest(x / list_sum(e), 1e-12)) AS p FROM (SELECT key, t, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM (
    SELECT s.key, s.t, list_transform(list_zip(a.v, b.v), lambda z: z[1] * (1 - s.w) + z[2] * s.w) AS v FROM (SELECT key, l, t, lo, least(lo + 1, n - 1) AS hi, src - lo AS w FROM
    (SELECT *, least(floor(src)::BIGINT, n - 1) AS lo FROM (SELECT u.key, c.label AS l, c.n, u.t, greatest((u.t + 0.5::DOUBLE) * c.n / u.m - 0.5, 0) AS src
    FROM (SELECT key, m, unnest(range(0, m)) AS t FROM ({sizes})) u JOIN c ON c.label = (u.key + {o}) % 10))) s JOIN f a ON a.label = s.l AND a.t = s.lo JOIN f b ON b.label = s.l AND b.t = s.hi)))"""


def _compared(a: int, b: int, name: str) -> str:
    """SQL (common table expressions) of the comparison of labels key + a and key + b."""
    sizes = f"SELECT k.label AS key, greatest(x.n, y.n) AS m FROM c k JOIN c x ON x.label = (k.label + {a}) % 10 JOIN c y ON y.label = (k.label + {b}) % 10"
    term = "0.5 * z[1] * (ln(z[1]) - ln((z[1] + z[2]) / 2)) + 0.5 * z[2] * (ln(z[2]) - ln((z[1] + z[2]) / 2))"
    sequence = lambda i: f"coalesce(string_agg(chr(48 + {i}::INTEGER), '' ORDER BY t) FILTER ({i} != 0 AND {i} IS DISTINCT FROM b{i}), '')"
    return f"""{name}_r AS (SELECT x.key, x.t, x.p, y.p AS q FROM {_resampled(a, sizes)} x JOIN {_resampled(b, sizes)} y ON x.key = y.key AND x.t = y.t),
    {name}_i AS (SELECT key, t, sqrt(greatest(list_sum(list_transform(list_zip(p, q), lambda z: {term})), 0)) AS js, list_sum(list_transform(list_zip(p, q), lambda z: -0.5 * (z[1] * ln(z[2]) + z[2] * ln(z[1])))) AS sce,
      list_sum(list_transform(p, lambda x: -x * ln(x))) AS ep, list_sum(list_transform(q, lambda x: -x * ln(x))) AS eq, list_position(p, list_max(p)) - 1 AS ip, list_position(q, list_max(q)) - 1 AS iq FROM {name}_r),
    {name}_j AS (SELECT *, lag(ip) OVER (PARTITION BY key ORDER BY t) AS bip, lag(iq) OVER (PARTITION BY key ORDER BY t) AS biq FROM {name}_i),
    {name} AS (SELECT *, levenshtein(x, y)::INTEGER AS edit_dist, levenshtein(x, y)::DOUBLE / greatest(len(x), len(y), 1) AS edit_norm FROM (SELECT key, avg(js) AS js, avg(sce) AS sce, avg((ip = iq)::INT) AS top1_acc, avg(ep) AS entropy_a, avg(eq) AS entropy_b,
      avg((ip = 0)::INT) AS blank_frac_a, avg((iq = 0)::INT) AS blank_frac_b, {sequence('ip')} AS x, {sequence('iq')} AS y FROM {name}_j GROUP BY key))"""


def labelled(s, d, o: int):
    """Frames (key, vec_id, p) of the label key + o, modulo 10."""
    return probabilities(s, d).select(F.pmod(F.col("label") - o, F.lit(10)).alias("key"), "vec_id", "p")


def compared(s, d):
    return posterior.comparison({"ctc": labelled(s, d, 0), "clean": labelled(s, d, 1), "noise": labelled(s, d, 2)}, "key", "vec_id", "p")


def mean_table(s, d):
    """v, h and e: the mean entry v of the vectors of label h."""
    long = t(s, d, "embeddings").select(F.col("label").alias("h"), F.posexplode("embedding").alias("v", "e"))
    return long.groupBy("v", "h").agg(F.avg(F.col("e").cast("double")).alias("e"))


_TABLE = "(SELECT v - 1 AS v, h, avg(e) AS e FROM (SELECT label AS h, unnest(range(1, 65)) AS v, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY ALL)"
_LENGTHS = r"list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0b]+'), lambda x: x != ''), lambda x: len(x)::INTEGER)"


def lengths(c):
    """The lengths of a text's words, as ids that any engine makes alike."""
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\r\n\f\x0b]+"), lambda x: x != ""), F.length)


def collated(s, d, left: bool):
    rows = t(s, d, "conversations").select("conv_id", "turn", lengths(F.col("text")).alias("ids")).withColumn("mask", M.attention(F.col("ids")))
    out = batching.collate(rows, ["conv_id"], {"ids": 0, "mask": False}, left)
    return out.select("conv_id", "turn", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "").alias("mask"))


def _collated(left: bool) -> str:
    fill = "list_transform(range(0, width - len(ids)), lambda x: %s)"
    ids, mask = (f"{fill % f} || {x}" if left else f"{x} || {fill % f}" for f, x in (("0::INTEGER", "ids"), ("0", "list_transform(ids, lambda x: 1)")))
    return f"SELECT conv_id, turn, array_to_string({ids}, ' ') AS ids, array_to_string({mask}, '') AS mask FROM (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS width FROM (SELECT conv_id, turn, {_LENGTHS} AS ids FROM conversations))"


_PROMPTS = {"en": "Say {} now.", "de": "Sag es.", "fr": "Dis-le.", "es": "Dilo."}


def prompted(s, d, append):
    """Documents as a manifest: the language is the task, the source goes where the task's prompt asks for more."""
    langs = t(s, d, "documents").select("lang").distinct()  # a row a language
    prompts = langs.select(F.col("lang").alias("task"), F.array(F.coalesce(F.create_map(*[F.lit(x) for kv in _PROMPTS.items() for x in kv])[F.col("lang")], F.lit("Go on."))).alias("prompts"))
    rows = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("task"), F.col("source").alias("en"))
    return M.with_prompt(rows, prompts, "<speech>{}", append=append).select("key", "prompt")


_PROMPT = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PROMPTS.items()) + " ELSE 'Go on.' END"


def sequences(s, d):
    """Prompt and target ids of the documents: the lengths of the language's name and of the text's words, with 2 at the end."""
    docs = t(s, d, "documents").select("doc_id", F.array(F.length("lang")).alias("prompt"), F.concat(lengths(F.col("text")), F.array(F.lit(2))).alias("target"))
    return docs.withColumns({"ids": F.concat("prompt", "target"), "labels": M.labels(F.col("prompt"), F.col("target"))})


def frames(s, d):
    """Frames of the user's events: a score for each kind of event."""
    kinds = ["click", "purchase", "signup", "view"]
    e = t(s, d, "events")
    return e.select("user_id", "ts", "event_id", F.array(*[F.when(F.col("event_type") == k, F.lit(1.0)).otherwise(F.pmod("event_id", F.lit(7)) / 100.0 + i / 1000.0) for i, k in enumerate(kinds)]).alias("scores"))


_SCORES = "[" + ", ".join(f"CASE WHEN event_type = '{k}' THEN 1.0::DOUBLE ELSE (event_id % 7) / 100.0::DOUBLE + {i} / 1000.0::DOUBLE END" for i, k in enumerate(["click", "purchase", "signup", "view"])) + "]"
_TOK = f"list_filter(regexp_split_to_array(upper(replace(text, 'ß', 'ss')), '{_WS}'), lambda x: x != '')"
_EXPAND = "SELECT *, sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - length AS start FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN floor(l_quantity)::BIGINT ELSE 1 END AS length FROM lineitem)"

def listed(vector):
    """A vector as text, in millionths."""
    return F.array_join(F.transform(vector, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), " ")


_PSD = f"""WITH e AS (SELECT x.*, y.embedding FROM ({_SOFT}) x JOIN embeddings y USING (vec_id)), b AS (SELECT vec_id % 20 AS u, vec_id, p, {{of}} AS v, list_position(p, list_max(p)) - 1 AS id FROM e),
c AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY vec_id) AS run FROM (SELECT *, (lag(id) OVER (PARTITION BY u ORDER BY vec_id) IS DISTINCT FROM id)::INT AS new FROM b))
SELECT u, min(vec_id) AS first, count(*) AS frames, {{more}}array_to_string(list_transform([{', '.join(f'avg(v[{k}])' for k in range(1, 65))}], lambda x: round(x * 1000000)::BIGINT), ' ') AS vector FROM c GROUP BY u, run, CASE WHEN id = 0 THEN vec_id ELSE -1 END HAVING avg(p[1]) < 0.9"""


def spoken_frames(s, d):
    """Posteriors of 20 utterances, of which the first n frames count (none of the first utterance)."""
    return probabilities(s, d).withColumn("u", F.col("vec_id") % 20).withColumn("n", F.col("u") * 3)


def framed(s, d):
    """20 utterances as arrays of frames of two numbers."""
    e = t(s, d, "embeddings").select((F.col("vec_id") % 20).alias("u"), F.struct("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v")).alias("x"))
    return e.groupBy("u").agg(F.sort_array(F.collect_list("x")).alias("x")).select("u", F.transform("x", lambda x: x.v).alias("frames"))


def interleaved(s, d, left: bool):
    """Turns of a conversation as padded sequences of word lengths, in which words of three letters stand for some slots."""
    rows = t(s, d, "conversations").select("conv_id", "turn", lengths(F.col("text")).alias("ids"))
    rows = rows.withColumns({"mask": F.transform("ids", lambda x: F.lit(1)), "labels": F.transform("ids", lambda x: x * 10), "slots": F.transform(F.filter("ids", lambda x: x == 3), lambda x, i: F.pmod(F.col("turn") + i, F.lit(4)) + 1)})
    rows = batching.collate(rows, ["conv_id"], {"ids": 0, "mask": 0, "labels": -100}, left)
    out = sequence.interleave(rows, ["conv_id"], "ids", "mask", "labels", "slots", 3, -7)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return out.select("conv_id", "turn", "left", text("ids"), text("mask"), text("labels"), text("position_ids"), F.array_join(F.transform("audio", lambda x: x.cast("int").cast("string")), "").alias("audio"))


def _interleaved(left: bool) -> str:
    side = "count(*) OVER b = 1 OR NOT max(len(w) < width) OVER b" if not left else "true"
    fill = lambda v: f"list_transform(range(0, gap), lambda k: {v})"
    both = lambda v, x: f"array_to_string(CASE WHEN l THEN {fill(v)} || {x} ELSE {x} || {fill(v)} END, ' ')"
    return f"""WITH w AS (SELECT conv_id, turn, {_LENGTHS} AS w, max(len({_LENGTHS})) OVER (PARTITION BY conv_id) AS width FROM conversations),
    p AS (SELECT *, list_filter(range(1, len(w) + 1), lambda k: w[k] = 3) AS place, {side} AS l FROM w WINDOW b AS (PARTITION BY conv_id)),
    x AS (SELECT *, flatten(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN w[k] = 3 THEN list_transform(range(0, (turn + list_position(place, k) - 1) % 4 + 1), lambda z: {{'i': -7, 'l': -100, 'a': 1}}) ELSE [{{'i': w[k], 'l': w[k] * 10, 'a': 0}}] END)) AS x FROM p),
    g AS (SELECT *, max(len(x) + width - len(w)) OVER (PARTITION BY conv_id) - len(x) AS gap FROM x)
    SELECT conv_id, turn, l AS "left", {both('-7', 'list_transform(x, lambda y: y.i)')} AS ids, {both('0', 'list_transform(x, lambda y: 1)')} AS mask, {both('-100', 'list_transform(x, lambda y: y.l)')} AS labels,
    {both('1', 'range(0, len(x))')} AS position_ids, replace({both('0', 'list_transform(x, lambda y: y.a)')}, ' ', '') AS audio FROM g"""


def inserted(s, d):
    """The documents' smoothed targets with an insertion for every ten rows."""
    place = lambda j, n: (F.col("doc_id") * 31 + j * j * 17) % (n + 1)
    return posterior.inserted(sequences(s, d), "doc_id", "target", 64, 0.1, place, lambda j, n: (F.col("doc_id") + j) % 2 == 0, F.col("doc_id") * 7919 % 1000 / 10000)


#: name: (query, SQL or None)
CATALOGUE = {
    "wer_overall": (lambda s, d: scoring.overall(pairs(s, d)).withColumn("wer", F.round("wer", 6)), _aligned(_PAIRS) + f"SELECT *, round({_WER}, 6) AS wer FROM (SELECT {_SUMS} FROM e)"),
    "wer_per_pair": (lambda s, d: scoring.per_pair(pairs(s, d)), _aligned(_PAIRS) + f"SELECT *, {_WER} AS wer FROM e"),
    "token_stats": (lambda s, d: scoring.token_counts(pairs(s, d)), _aligned(_PAIRS) + "SELECT * FROM tk"),
    "wer_by_cluster_rollup": (lambda s, d: scoring.by_cluster(pairs(s, d)), _aligned(_PAIRS) + f"SELECT cluster, {_SUMS} FROM ck GROUP BY ROLLUP (cluster)"),
    "wer_reference_tokens": (
        lambda s, d: pairs(s, d).agg(F.sum(F.size("ref")).alias("ref_tokens"), F.sum(F.size("hyp")).alias("hyp_tokens"), F.count("*").alias("pairs")),
        f"WITH {_PAIRS} SELECT sum(len(ref))::BIGINT AS ref_tokens, sum(len(hyp))::BIGINT AS hyp_tokens, count(*) AS pairs FROM q",
    ),
    "hyp_last_wins": (
        lambda s, d: scoring.last_wins(t(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id"),
        "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    ),
    "norm_target_train": (
        lambda s, d: t(s, d, "documents").select("doc_id", X.train_target(F.col("text")).alias("target")),
        f"SELECT doc_id, trim(lower(regexp_replace(text, '[^A-Za-z{X.SPACES}.,!?'']+', '', 'g')), '{X.SPACES}') AS target FROM documents",
    ),
    "norm_target_decode": (
        lambda s, d: t(s, d, "documents").select("doc_id", X.decode_target(F.col("text")).alias("target")),
        f"SELECT doc_id, trim(lower(regexp_replace(text, '[^A-Za-z{X.SPACES}.,!?]+', '', 'g')), '{X.SPACES}') AS target FROM documents",
    ),
    "strip_tags": (
        lambda s, d: t(s, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text")),
        "SELECT page_id, regexp_replace(html, '(?s)<[^>]*>?', '', 'g') AS text FROM pages",
    ),
    "clean_marks_ascii": (
        lambda s, d: t(s, d, "documents").select("doc_id", X.clean_marks(F.col("text")).alias("text")),
        f"SELECT doc_id, regexp_replace(text, '{X.MARKS.replace("'", "''")}', '', 'g') AS text FROM documents",
    ),
    "token_cluster_ascii": (
        lambda s, d: t(s, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy(X.cluster(F.col("token")).alias("cluster")).agg(F.count("*").alias("n")),
        f"SELECT CASE WHEN regexp_matches(b, '^[0-9]+$') THEN 'Number' WHEN regexp_matches(b, '^[A-Za-z]+$') THEN 'English' ELSE 'Other' END AS cluster, count(*) AS n FROM (SELECT regexp_replace(x, '[&''@=.\\-_#+;]', '', 'g') AS b FROM (SELECT unnest({_TOK}) AS x FROM documents)) GROUP BY 1",
    ),
    "token_union_distinct": (
        lambda s, d: pairs(s, d).select(F.explode(F.concat("ref", "hyp")).alias("token")).distinct(),
        f"WITH {_PAIRS} SELECT DISTINCT unnest(ref || hyp) AS token FROM q",
    ),
    "ignore_words_anti": (
        lambda s, d: t(s, d, "documents").select("doc_id", F.size(X.normalize(X.characterize(F.coalesce("text", F.lit(""))), F.array(F.lit("THE"), F.lit("OF"), F.lit("AND")))).alias("kept")),
        f"SELECT doc_id, len(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{X.TOKEN}'), lambda x: upper(replace(x, 'ß', 'ss'))), lambda x: x NOT IN ('THE', 'OF', 'AND')), lambda x: regexp_replace(x, '(?s)<[^>]*>?', '', 'g')), lambda x: x != ''))::INTEGER AS kept FROM documents",
    ),
    "split_words_flatten": (
        lambda s, d: t(s, d, "documents").select("doc_id", F.array_join(X.normalize(X.characterize(F.coalesce("text", F.lit(""))), split=F.create_map(F.lit("THE"), F.array(F.lit("T"), F.lit("HE")), F.lit("AND"), F.array(F.lit("A"), F.lit("N"), F.lit("D")))), " ").alias("words")),
        f"SELECT doc_id, array_to_string(flatten(list_transform({_CHAR}, lambda x: CASE WHEN x = 'THE' THEN ['T', 'HE'] WHEN x = 'AND' THEN ['A', 'N', 'D'] ELSE [x] END)), ' ') AS words FROM documents",
    ),
    "characterize": (
        lambda s, d: t(s, d, "documents").select("doc_id", F.array_join(X.characterize(F.coalesce("text", F.lit(""))), "|").alias("tokens")),
        f"SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '{X.TOKEN}'), '|') AS tokens FROM documents",
    ),
    "wer_errors_per_pair": (
        lambda s, d: scoring.errors(pairs(s, d)).withColumn("wer", F.round("wer", 6)),
        _edits(_PAIRS) + f"SELECT id, n, errors, {_RATE} FROM e",
    ),
    "wer_errors_overall": (
        lambda s, d: scoring.errors(pairs(s, d)).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors")).withColumn("wer", F.round(scoring.rate(F.col("errors"), F.col("n")), 6)),
        _edits(_PAIRS) + f"SELECT n, errors, {_RATE} FROM (SELECT sum(n)::BIGINT AS n, sum(errors)::BIGINT AS errors FROM e)",
    ),
    "wer_zero_ref": (
        lambda s, d: scoring.errors(pairs(s, d).withColumns({c: F.filter(c, lambda x: x.rlike("[0-9]")) for c in ("ref", "hyp")})).withColumn("wer", F.round("wer", 6)),
        _edits(_PAIRS.replace("r.w AS ref, h.w AS hyp", f"{_DIGITS.replace('(w', '(r.w')} AS ref, {_DIGITS.replace('(w', '(h.w')} AS hyp")) + f"SELECT id, n, errors, {_RATE} FROM e",
    ),
    "wer_report": (
        lambda s, d: scoring.report(pairs(s, d)),
        _aligned(_PAIRS)
        + f"""SELECT 'WER: ' || printf('%.2f', {_WER}) || ' %' || {_COUNTED} AS line FROM e UNION ALL SELECT 'Overall -> ' || printf('%.2f', {_WER}) || ' %' || {_COUNTED} FROM (SELECT {_SUMS} FROM e)
        UNION ALL SELECT cluster || ' -> ' || printf('%.2f', {_WER}) || ' %' || {_COUNTED} FROM (SELECT cluster, {_SUMS} FROM ck GROUP BY cluster)""",
    ),
    "wer_report_aligned": (lambda s, d: scoring.report(pairs(s, d), aligned=True, words=12), None),
    "prompt_join": (
        lambda s, d: prompted(s, d, ()),
        f"SELECT doc_id::VARCHAR AS key, '<speech>' || {_PROMPT} AS prompt FROM documents",
    ),
    "prompt_append_info": (
        lambda s, d: prompted(s, d, ("en",)),
        f"SELECT doc_id::VARCHAR AS key, '<speech>' || CASE WHEN lang = 'en' THEN replace({_PROMPT}, '{{}}', coalesce(source, '')) ELSE {_PROMPT} END AS prompt FROM documents",
    ),
    "sequence_labels": (
        lambda s, d: sequences(s, d).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"), F.size(M.attention(F.col("ids"))).alias("n")),
        f"SELECT doc_id, array_to_string([len(lang)] || w || [2], ' ') AS ids, array_to_string([-100] || w || [2], ' ') AS labels, (len(w) + 2)::INTEGER AS n FROM (SELECT doc_id, lang, {_LENGTHS} AS w FROM documents)",
    ),
    "encode_words": (
        lambda s, d: M.encode(t(s, d, "benchmark").select("item_id", X.words(F.col("text")).alias("w")), "item_id", "w", M.vocabulary(pairs(s, d).select(F.explode("ref").alias("word"))), -1).select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids")),
        f"WITH {_PAIRS}, v AS (SELECT word, row_number() OVER (ORDER BY encode(word)) AS id FROM (SELECT DISTINCT unnest(ref) AS word FROM q)), b AS (SELECT item_id, {_CHAR} AS w FROM benchmark), l AS (SELECT item_id, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM b), x AS (SELECT l.item_id, string_agg(coalesce(v.id, 0)::VARCHAR, ' ' ORDER BY place) AS ids FROM l LEFT JOIN v USING (word) GROUP BY l.item_id) SELECT b.item_id, coalesce(x.ids || ' ', '') || '-1' AS ids FROM b LEFT JOIN x USING (item_id)",
    ),
    "collate_left": (lambda s, d: collated(s, d, True), _collated(True)),
    "collate_right": (lambda s, d: collated(s, d, False), _collated(False)),
    "batch_lists": (
        lambda s, d: batching.batches(batching.dynamic_batches(sized(s, d), "user_id", ["ts", "event_id"], "size", 200), ["user_id", "batch"], "ts", ["event_id", "size"]).select("user_id", "batch", F.array_join(F.transform("event_id", lambda x: x.cast("string")), " ").alias("events")),
        _FOLD.replace("s AS (SELECT user_id, event_id,", "s AS (SELECT user_id, event_id, ts,") + "SELECT user_id, batch, string_agg(event_id::VARCHAR, ' ' ORDER BY k) AS events FROM r GROUP BY user_id, batch",
    ),
    "length_mask": (
        lambda s, d: sized(s, d).select("event_id", F.array_join(F.transform(batching.length_mask(F.col("size"), F.lit(50)), lambda x: x.cast("int").cast("string")), "").alias("mask")),
        "SELECT event_id, repeat('1', size) || repeat('0', 50 - size) AS mask FROM (SELECT event_id, (floor(value) % 50 + 1)::INT AS size FROM events)",
    ),
    "prefix_drop": (
        lambda s, d: t(s, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(batching.drop_prefix(F.col("embedding"), F.col("vec_id") % 9, 4), ("kept", "length"), strict=True)]).select("vec_id", F.size("kept").alias("n"), F.round(F.col("kept")[0].cast("double"), 6).alias("first"), "length", batching.downsampled(F.col("length"), 2).alias("half")),
        "SELECT vec_id, len(embedding[5:])::INTEGER AS n, round(embedding[5]::DOUBLE, 6) AS first, greatest(vec_id % 9 - 4, 0) AS length, greatest(vec_id % 9 - 4, 0) // 2 AS half FROM embeddings",
    ),
    "audio_seconds": (
        lambda s, d: batching.audio_seconds(sized(s, d), ["user_id"], "size").select("user_id", F.round("seconds", 6).alias("seconds")),
        "SELECT user_id, round(sum(floor(value) % 50 + 1) * 60.0::DOUBLE / 1000, 6) AS seconds FROM events GROUP BY user_id",
    ),
    "ctc_greedy_decode": (
        lambda s, d: sequence.greedy(frames(s, d).withColumn("at", F.struct("ts", "event_id")), "user_id", "at", "scores", 3).select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids")),
        f"""WITH f AS (SELECT user_id, ts, event_id, list_position(v, list_max(v)) - 1 AS id FROM (SELECT user_id, ts, event_id, {_SCORES} AS v FROM events)), g AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM f)
        SELECT user_id, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY ts, event_id) FILTER (id != 3 AND id IS DISTINCT FROM b), '') AS ids FROM g GROUP BY user_id""",
    ),
    "ban_entry": (
        lambda s, d: probabilities(s, d).select("vec_id", posterior.best(posterior.ban(F.col("p"), 0)).alias("best")),
        f"SELECT vec_id, list_position(p[2:], list_max(p[2:])) AS best FROM ({_SOFT})",
    ),
    "log_prob_detect": (
        lambda s, d: posterior.probabilities(probabilities(s, d).withColumn("p", F.transform("p", lambda x: F.log(x))), "p").select("vec_id", F.round(F.array_max("p"), 6).alias("top")),
        f"SELECT vec_id, round(list_max(p), 6) AS top FROM ({_SOFT})",
    ),
    "psd_encoder_merge": (
        lambda s, d: sequence.merge_encoded(probabilities(s, d).join(t(s, d, "embeddings").select("vec_id", "embedding"), "vec_id").withColumn("u", F.col("vec_id") % 20), "u", "vec_id", "p", "embedding").select("u", "first", "frames", F.round("blank", 6).alias("blank"), listed(F.col("vector")).alias("vector")),
        _PSD.format(of="embedding::DOUBLE[]", more="round(avg(p[1]), 6) AS blank, "),
    ),
    "resample_log_linear": (
        lambda s, d: posterior.resample(labelled(s, d, 0), "key", "vec_id", "p", labelled(s, d, 0).groupBy("key").agg((F.count("*") + 3).alias("length"))).select("key", "t", F.round(F.col("p")[0], 6).alias("first"), F.round(F.array_max("p"), 6).alias("top")),
        f"WITH {_FRAMES % _SOFT} SELECT key, t, round(p[1], 6) AS first, round(list_max(p), 6) AS top FROM {_resampled(0, 'SELECT label AS key, n + 3 AS m FROM c')}",
    ),
    "comparison": (
        lambda s, d: (c := compared(s, d)).select("key", *[F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in c.dtypes if n != "key"]),
        f"WITH {_FRAMES % _SOFT}, {_compared(0, 1, 'ctc_clean')}, {_compared(0, 2, 'ctc_noise')}, {_compared(2, 1, 'noise_clean')} SELECT key, "
        + ", ".join(
            f"{r}.{m} AS {n}" if m == "edit_dist" else f"len({r}.{'x' if m == 'len_a' else 'y'})::INTEGER AS {n}" if m.startswith("len") else f"round({r}.{m}, 6) AS {n}"
            for r in ("ctc_clean", "ctc_noise", "noise_clean")
            for m in posterior.METRICS
            for n in [f"{r}_{m[:-1] + r.split('_')[m[-1] == 'b'] if m[-2:] in ('_a', '_b') else m}"]
        )
        + ", round(ctc_noise.js - ctc_clean.js, 6) AS delta FROM ctc_clean JOIN ctc_noise USING (key) JOIN noise_clean USING (key)",
    ),
    "delta_summary": (
        lambda s, d: posterior.delta_summary(compared(s, d)).select(F.round("mean_delta", 6).alias("mean_delta"), F.round("below_zero", 6).alias("below_zero")),
        f"WITH {_FRAMES % _SOFT}, {_compared(0, 1, 'x')}, {_compared(0, 2, 'y')} SELECT round(avg(y.js - x.js), 6) AS mean_delta, round(avg((y.js < x.js)::INT) * 100, 6) AS below_zero FROM x JOIN y USING (key)",
    ),
    "soft_embedding": (
        lambda s, d: posterior.soft_embedding(probabilities(s, d), ["vec_id"], "p", mean_table(s, d), blank_last=True).select("vec_id", "h", F.round("x", 6).alias("x")),
        f"SELECT vec_id, h, round(sum(x * e), 6) AS x FROM (SELECT vec_id, unnest(range(0, 63)) AS v, unnest(list_transform(q, lambda x: exp(x - list_max(q)) / list_sum(list_transform(q, lambda y: exp(y - list_max(q)))))) AS x FROM (SELECT vec_id, p[1:63] AS q FROM ({_SOFT}))) JOIN {_TABLE} USING (v) GROUP BY vec_id, h",
    ),
    "top1_gather": (
        lambda s, d: posterior.top1_gather(probabilities(s, d), ["vec_id"], "p", mean_table(s, d)).select("vec_id", "h", F.round("x", 6).alias("x")),
        f"SELECT vec_id, h, round(e, 6) AS x FROM (SELECT vec_id, list_position(p, list_max(p)) - 1 AS v FROM ({_SOFT})) JOIN {_TABLE} USING (v)",
    ),
    "pseudo_posterior_onehot": (
        lambda s, d: posterior.pseudo_posterior(sequences(s, d), "doc_id", "target", 64).select("doc_id", "t", "id", "p"),
        f"SELECT doc_id, unnest(range(0, len(w)))::INTEGER AS t, unnest(w) AS id, 1.0::DOUBLE AS p FROM (SELECT doc_id, {_LENGTHS} || [2] AS w FROM documents)",
    ),
    "pseudo_posterior_smooth": (
        lambda s, d: posterior.pseudo_posterior(sequences(s, d), "doc_id", "target", 64, F.col("doc_id") * 7919 % 1000 / 10000, (F.col("doc_id") * 31 + F.col("at") * 17) % 20 != 0).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.sum("id").alias("ids"), F.round(F.max("p"), 6).alias("p"), F.round(F.max("rest"), 6).alias("rest")),
        f"SELECT doc_id, count(*) AS n, (count(*) - 1)::INTEGER AS last, sum(id)::BIGINT AS ids, round(max(1 - a + a / 64), 6) AS p, round(max(a / 64), 6) AS rest FROM (SELECT doc_id, doc_id * 7919 % 1000 / 10000.0::DOUBLE AS a, unnest(range(0, len(w))) AS place, unnest(w) AS id FROM (SELECT doc_id, {_LENGTHS} || [2] AS w FROM documents)) WHERE (doc_id * 31 + place * 17) % 20 != 0 GROUP BY doc_id",
    ),
    "pseudo_posterior_insert": (
        lambda s, d: inserted(s, d).select("doc_id", "t", "id", F.round("p", 6).alias("p"), F.round("rest", 6).alias("rest")),
        f"""WITH w AS (SELECT doc_id, {_LENGTHS} || [2] AS w, doc_id * 7919 % 1000 / 10000.0::DOUBLE AS a FROM documents),
        j AS (SELECT doc_id, w, a, unnest(range(0, floor(len(w) * 0.1)::INTEGER)) AS j FROM w), p AS (SELECT *, (doc_id * 31 + j * j * 17) % (len(w) + 1) AS place, (doc_id + j) % 2 = 0 AS dup FROM j),
        r AS (SELECT doc_id, k AS place, 1 AS own, 0 AS j, w[k + 1] AS id, 1 - a + a / 64 AS p, a / 64 AS rest FROM (SELECT *, unnest(range(0, len(w))) AS k FROM w)
          UNION ALL SELECT doc_id, place, 0, j, CASE WHEN dup THEN w[greatest(place, 1)] ELSE 0 END, CASE WHEN dup THEN 1 - a + a / 64 ELSE 1 END, CASE WHEN dup THEN a / 64 ELSE 0 END FROM p)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place, own, j) - 1)::INTEGER AS t, id, round(p, 6) AS p, round(rest, 6) AS rest FROM r""",
    ),
    "interleave_left": (lambda s, d: interleaved(s, d, True), _interleaved(True)),
    "interleave_right": (lambda s, d: interleaved(s, d, False), _interleaved(False)),
    "mask_positions": (
        lambda s, d: batching.collate(t(s, d, "conversations").select("conv_id", "turn", F.transform(lengths(F.col("text")), lambda x: x % 5 != 0).alias("mask")), ["conv_id"], {"mask": False}, True).select("conv_id", "turn", F.array_join(F.transform(sequence.position_ids("mask"), lambda x: x.cast("string")), " ").alias("positions")),
        f"""WITH m AS (SELECT conv_id, turn, list_transform({_LENGTHS}, lambda x: (x % 5 != 0)::INT) AS m FROM conversations), p AS (SELECT conv_id, turn, list_transform(range(0, max(len(m)) OVER (PARTITION BY conv_id) - len(m)), lambda x: 0) || m AS m FROM m)
        SELECT conv_id, turn, array_to_string(list_transform(range(1, len(m) + 1), lambda k: CASE WHEN m[k] = 1 THEN list_sum(m[1:k]) - 1 ELSE 1 END), ' ') AS positions FROM p""",
    ),
    "policy_batches": (
        lambda s, d: batching.dynamic_batches(sized(s, d).withColumn("frames", F.col("event_id") % 90), "user_id", ["ts", "event_id"], batching.frames_and_tokens("size", "frames", 300, 6)).select("user_id", "event_id", "batch"),
        _FOLD.replace("(floor(value) % 50 + 1)::INT AS size", "(floor(value) % 50 + event_id % 90 // 6)::INT AS size").replace("200", "300") + "SELECT user_id, event_id, batch FROM r",
    ),
    "total_batches": (
        lambda s, d: batching.dynamic_batches(sized(s, d), "user_id", ["ts", "event_id"], batching.total("size", 120)).select("user_id", "event_id", "batch"),
        """WITH RECURSIVE s AS (SELECT user_id, event_id, (floor(value) % 50 + 1)::INT AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT user_id, event_id, k, 0 AS batch, size AS held FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.event_id, s.k, CASE WHEN held + size > 120 THEN batch + 1 ELSE batch END, CASE WHEN held + size > 120 THEN size ELSE held + size END FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
        SELECT user_id, event_id, batch FROM r""",
    ),
    "token_clusters": (
        lambda s, d: scoring.by_clusters(pairs(s, d), t(s, d, "nation").select(F.concat(F.lit("region "), "n_regionkey").alias("cluster"), F.upper("n_name").alias("word")).unionByName(t(s, d, "documents").select(F.lit("languages").alias("cluster"), F.explode(F.array(F.lit("THE"), F.lit("A"), F.lit("IS"))).alias("word")).distinct())),
        _aligned(_PAIRS) + f"SELECT cluster, {_SUMS} FROM tk JOIN (SELECT 'region ' || n_regionkey AS cluster, upper(n_name) AS token FROM nation UNION ALL SELECT 'languages', unnest(['THE', 'A', 'IS'])) USING (token) GROUP BY cluster",
    ),
    "gt_decode": (
        lambda s, d: t(s, d, "documents").select("doc_id", M.spoken(F.replace("text", F.lit("\\"), F.lit("/"))).alias("text")),
        "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(replace(coalesce(text, ''), '\\', '/'))), '..'), lambda x: chr(CAST('0x' || x AS INTEGER))), '') AS text FROM documents",
    ),
    "query_frames": (
        lambda s, d: framed(s, d).select("u", *[c.alias(n) for c, n in zip(batching.with_queries(F.col("frames"), F.size("frames"), [F.array(F.lit(1.0), F.col("u") * 0.5), F.when(F.col("u") % 2 == 0, F.array(F.lit(0.0), F.lit(2.0)))]), ("frames", "n"), strict=True)]).select("u", "n", F.posexplode("frames").alias("place", "v")).select("u", "n", "place", listed(F.col("v")).alias("v")),
        """WITH f AS (SELECT vec_id % 20 AS u, list([embedding[1]::DOUBLE, embedding[2]::DOUBLE] ORDER BY vec_id) AS f FROM embeddings GROUP BY 1), q AS (SELECT u, [[1.0::DOUBLE, u * 0.5::DOUBLE]] || CASE WHEN u % 2 = 0 THEN [[0.0::DOUBLE, 2.0::DOUBLE]] ELSE [] END || f AS x FROM f)
        SELECT u, len(x)::INTEGER AS n, unnest(range(0, len(x)))::INTEGER AS place, array_to_string(list_transform(unnest(x), lambda y: round(y * 1000000)::BIGINT), ' ') AS v FROM q""",
    ),
    "posterior_keys": (
        lambda s, d: posterior.listed_keys({"ctc": labelled(s, d, 0), "clean": labelled(s, d, 1), "noise": labelled(s, d, 2)}, "key"),
        "SELECT DISTINCT label AS key FROM embeddings",
    ),
    "next_token_accuracy": (
        lambda s, d: metrics.next_token_accuracy(sequences(s, d), "ids", "labels").select(F.round("accuracy", 6).alias("accuracy")),
        f"SELECT round(avg((x = y)::INT), 6) AS accuracy FROM (SELECT unnest(i[1:len(i) - 1]) AS x, unnest(i[2:]) AS y FROM (SELECT [len(lang)] || {_LENGTHS} || [2] AS i FROM documents))",
    ),
    "sinusoid": (
        lambda s, d: t(s, d, "nation").select("n_nationkey", F.transform(posterior.sinusoid(F.col("n_nationkey") + 1, 8), lambda x: F.round(x, 6)).alias("x")).select("n_nationkey", F.col("x")[1].alias("sine"), F.col("x")[5].alias("cosine")),
        "SELECT n_nationkey, round(sin((n_nationkey + 1) * pow(10000.0, -1.0 / 3)), 6) AS sine, round(cos((n_nationkey + 1) * pow(10000.0, -1.0 / 3)), 6) AS cosine FROM nation",
    ),
    "run_averages": (
        lambda s, d: metrics.run_averages(t(s, d, "events"), ["value"]).select(F.round("value", 6).alias("value")),
        "SELECT round(coalesce(avg(value), 0), 6) AS value FROM events",
    ),
    "expanded_labels": (
        lambda s, d: sequence.expanded_labels(sequence.expand(t(s, d, "lineitem"), "l_orderkey", _ORDER, F.col("l_returnflag") == "R", F.floor("l_quantity")), "l_orderkey", "l_partkey", "l_suppkey", F.col("l_returnflag") == "R", 0).select("l_orderkey", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"), F.col("ids")[0].alias("first")),
        f"SELECT l_orderkey, sum(length)::INTEGER AS n, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey END)::BIGINT AS ids, sum(CASE WHEN l_returnflag = 'R' THEN -100 * length ELSE l_suppkey END)::BIGINT AS labels, arg_min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey END, start) AS first FROM ({_EXPAND}) GROUP BY l_orderkey",
    ),
    "forced_align": (
        lambda s, d: frames(s, d).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "scores"))), lambda x: F.transform(x.scores, lambda y: F.log(y + 1e-6))).alias("scores")).join(sequence.greedy(frames(s, d).withColumn("at", F.struct("ts", "event_id")), "user_id", "at", "scores", 3), "user_id").select("user_id", F.array_join(F.transform(align_frames("scores", "ids", 3), lambda x: x.cast("string")), " ").alias("ids")),
        f"""WITH RECURSIVE f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, v, list_position(v, list_max(v)) - 1 AS id FROM (SELECT user_id, ts, event_id, {_SCORES} AS v FROM events)),
        g AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY t) AS b FROM f), y AS (SELECT user_id, max(t) AS last, coalesce(list(id ORDER BY t) FILTER (id != 3 AND id IS DISTINCT FROM b), []) AS ids FROM g GROUP BY user_id),
        k AS MATERIALIZED (SELECT user_id, last, k, 2 * len(ids) + 1 AS n, CASE WHEN k % 2 = 0 THEN 3 ELSE ids[(k + 1) // 2] END AS label, k % 2 = 1 AND k > 2 AND ids[(k + 1) // 2] != ids[(k - 1) // 2] AS skip FROM (SELECT *, unnest(range(0, 2 * len(ids) + 1)) AS k FROM y)),
        m AS MATERIALIZED (SELECT user_id, t, list_transform(v, lambda x: ln(x + 1e-6)) AS v FROM f),
        d AS (SELECT k.*, 0 AS t, CASE WHEN k < 2 THEN v[label + 1] ELSE '-inf'::DOUBLE END AS best, label::VARCHAR AS path FROM k JOIN m USING (user_id) WHERE t = 0 UNION ALL
        SELECT user_id, last, k, n, label, skip, t, greatest(best, b, c) + v[label + 1], CASE WHEN best >= b AND best >= c THEN path WHEN b >= c THEN bp ELSE cp END || ' ' || label FROM
        (SELECT d.* EXCLUDE (t), m.t, v, coalesce(lag(best) OVER w, '-inf'::DOUBLE) AS b, lag(path) OVER w AS bp, CASE WHEN skip THEN coalesce(lag(best, 2) OVER w, '-inf'::DOUBLE) ELSE '-inf'::DOUBLE END AS c, lag(path, 2) OVER w AS cp FROM d JOIN m ON m.user_id = d.user_id AND m.t = d.t + 1 WINDOW w AS (PARTITION BY d.user_id ORDER BY k)))
        SELECT user_id, arg_max(path, CASE WHEN k = n - 1 THEN {{'a': best, 'b': 0}} ELSE {{'a': best, 'b': 1}} END) AS ids FROM d WHERE t = last AND k >= n - 2 GROUP BY user_id""",
    ),
    "file_ext": (
        lambda s, d: t(s, d, "pages").select("page_id", X.extension(F.col("url")).alias("ext")),
        r"SELECT page_id, lower(regexp_extract(url, '(\.[^./]*)$', 1)) AS ext FROM pages",
    ),
    "tsv_emit": (
        lambda s, d: t(s, d, "conversations").select(F.concat_ws("\t", F.concat_ws("-", "conv_id", "turn"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line")),
        r"SELECT conv_id || '-' || turn || E'\t' || replace(text, E'\n', ' ') AS line FROM conversations",
    ),
    "lang_map_default": (
        lambda s, d: t(s, d, "documents").select("doc_id", X.language_id(F.col("lang")).alias("lang_id")),
        f"SELECT doc_id, (CASE lang {_LANG} ELSE 0 END)::INTEGER AS lang_id FROM documents",
    ),
    "shard_assignment": (
        lambda s, d: t(s, d, "events").where(shard(F.col("event_id"), 4, 1, 2, 3)).select("event_id"),
        "SELECT event_id FROM events WHERE event_id % 8 = 7",
    ),
    "duration_filter": (
        lambda s, d: t(s, d, "events").where(F.col("value").between(0.1, 30)).select("event_id", "value"),
        "SELECT event_id, value FROM events WHERE value BETWEEN 0.1 AND 30",
    ),
    "ctc_collapse": (
        lambda s, d: sequence.collapse(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_type", "view").select("user_id", F.concat_ws(" ", "ids").alias("ids")),
        _RUNS + "SELECT user_id, coalesce(string_agg(x, ' ' ORDER BY run) FILTER (WHERE x != 'view'), '') AS ids FROM (SELECT DISTINCT user_id, run, x FROM g) GROUP BY user_id",
    ),
    "run_timestamps": (
        lambda s, d: sequence.timestamps(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_type", "view").select("user_id", F.col("run").cast("long").alias("run"), "symbol", F.round("start", 6).alias("start"), F.round("end", 6).alias("end")),
        _RUNS + "SELECT user_id, run::BIGINT AS run, any_value(x) AS symbol, round(greatest((min(t) * 60 - 30)::DOUBLE / 1000, 0), 6) AS start, round(least(((max(t) + 1) * 60 - 30)::DOUBLE / 1000, (any_value(n) * 60 - 30)::DOUBLE / 1000), 6) AS \"end\" FROM g WHERE x != 'view' GROUP BY user_id, run",
    ),
    "psd_merge": (
        lambda s, d: sequence.merge_frames(probabilities(s, d).withColumn("u", F.col("vec_id") % 20), "u", "vec_id", "p").select("u", "first", "frames", listed(F.col("vector")).alias("vector")),
        _PSD.format(of="p", more=""),
    ),
    "psd_utterances": (
        lambda s, d: sequence.utterances(
            sequence.merge_frames(spoken_frames(s, d), "u", "vec_id", "p", length="n"), spoken_frames(s, d).groupBy("u").agg((F.min("u") % 3).alias("b")), "u", 64, "b"
        ).select("u", "length", F.posexplode("vectors").alias("place", "v")).select("u", "length", "place", listed(F.col("v")).alias("vector")),
        f"""WITH e AS ({_SOFT}), a AS (SELECT vec_id % 20 AS u, vec_id, p, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) - 1 AS t FROM e), b AS (SELECT *, list_position(p, list_max(p)) - 1 AS id FROM a WHERE t < u * 3),
        c AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY vec_id) AS run FROM (SELECT *, (lag(id) OVER (PARTITION BY u ORDER BY vec_id) IS DISTINCT FROM id)::INT AS new FROM b)),
        m AS (SELECT u, min(vec_id) AS first, [{', '.join(f'avg(p[{k}])' for k in range(1, 65))}] AS v FROM c GROUP BY u, run, CASE WHEN id = 0 THEN vec_id ELSE -1 END HAVING avg(p[1]) < 0.9),
        r AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY first) - 1 AS place FROM m),
        l AS (SELECT x.u, x.u % 3 AS b, count(r.u)::INTEGER AS length FROM (SELECT DISTINCT u FROM a) x LEFT JOIN r ON r.u = x.u GROUP BY x.u),
        w AS (SELECT u, length, unnest(range(0, max(length) OVER (PARTITION BY b)))::INTEGER AS place FROM l)
        SELECT w.u, w.length, w.place, array_to_string(list_transform(coalesce(v, list_transform(range(0, 64), lambda x: 0.0::DOUBLE)), lambda x: round(x * 1000000)::BIGINT), ' ') AS vector FROM w LEFT JOIN r ON r.u = w.u AND r.place = w.place""",
    ),
    "frame_stack": (
        lambda s, d: sequence.stack(t(s, d, "embeddings").withColumn("u", F.col("vec_id") % 20), "u", "vec_id", "embedding", 4).select("u", "step", F.size("stacked").alias("width"), F.round(F.col("stacked")[64].cast("double"), 6).alias("x")),
        "WITH f AS (SELECT vec_id % 20 AS u, embedding, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) - 1 AS t FROM embeddings) SELECT u, t // 4 AS step, sum(len(embedding))::INTEGER AS width, round(max(CASE WHEN t % 4 = 1 THEN embedding[1] END)::DOUBLE, 6) AS x FROM f GROUP BY u, t // 4 HAVING count(*) = 4",
    ),
    "placeholder_expand": (
        lambda s, d: sequence.expand(t(s, d, "lineitem"), "l_orderkey", _ORDER, F.col("l_returnflag") == "R", F.floor("l_quantity")).groupBy("l_orderkey").agg(F.sum("length").alias("slots"), F.max(F.col("start") + F.col("length") - 1).alias("last"), F.sum("start").alias("starts")),
        f"SELECT l_orderkey, sum(length)::BIGINT AS slots, max(start + length - 1)::BIGINT AS last, sum(start)::BIGINT AS starts FROM ({_EXPAND}) GROUP BY l_orderkey",
    ),
    "position_ids": (
        lambda s, d: sequence.expand(t(s, d, "lineitem"), "l_orderkey", _ORDER, F.col("l_returnflag") == "R", F.floor("l_quantity")).select("l_orderkey", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("position")).groupBy("l_orderkey").agg(F.sum("position").alias("positions"), F.count("*").alias("n")),
        f"SELECT l_orderkey, sum(position)::BIGINT AS positions, count(*) AS n FROM (SELECT l_orderkey, unnest(range(start::BIGINT, (start + length)::BIGINT)) AS position FROM ({_EXPAND})) GROUP BY l_orderkey",
    ),
    "dynamic_batches": (
        lambda s, d: batching.dynamic_batches(sized(s, d), "user_id", ["ts", "event_id"], "size", 200).select("user_id", "event_id", "size", "batch"),
        _FOLD + "SELECT user_id, event_id, size, batch FROM r",
    ),
    "batch_padding_stats": (
        lambda s, d: batching.dynamic_batches(sized(s, d), "user_id", ["ts", "event_id"], "size", 200).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.max("size").alias("longest"), F.sum("size").alias("used")),
        _FOLD + "SELECT user_id, batch, count(*) AS n, max(size) AS longest, sum(size)::BIGINT AS used FROM r GROUP BY user_id, batch",
    ),
    "js_pairs": (
        lambda s, d: neighbours(s, d).select("vec_id", F.round(posterior.js_distance(F.col("p"), F.col("q")), 6).alias("js")),
        _NEAR + "SELECT vec_id, round(sqrt(greatest(list_sum(list_transform(list_zip(p, q), lambda z: 0.5 * greatest(z[1], 1e-12) * (ln(greatest(z[1], 1e-12)) - ln((greatest(z[1], 1e-12) + greatest(z[2], 1e-12)) / 2)) + 0.5 * greatest(z[2], 1e-12) * (ln(greatest(z[2], 1e-12)) - ln((greatest(z[1], 1e-12) + greatest(z[2], 1e-12)) / 2)))), 0)), 6) AS js FROM n",
    ),
    "sce_pairs": (
        lambda s, d: neighbours(s, d).select("vec_id", F.round(posterior.cross_entropy(F.col("p"), F.col("q")), 6).alias("sce")),
        _NEAR + "SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda z: -0.5 * (greatest(z[1], 1e-12) * ln(greatest(z[2], 1e-12)) + greatest(z[2], 1e-12) * ln(greatest(z[1], 1e-12))))), 6) AS sce FROM n",
    ),
    "entropy_mean": (
        lambda s, d: probabilities(s, d).groupBy("label").agg(F.round(F.avg(posterior.entropy(F.col("p"))), 6).alias("entropy")),
        f"SELECT label, round(avg(list_sum(list_transform(p, lambda x: -greatest(x, 1e-12) * ln(greatest(x, 1e-12))))), 6) AS entropy FROM ({_SOFT}) GROUP BY label",
    ),
    "top1_agree": (
        lambda s, d: neighbours(s, d).agg(F.round(F.avg((posterior.best(F.col("p")) == posterior.best(F.col("q"))).cast("double")), 6).alias("agree")),
        _NEAR + "SELECT round(avg((list_position(p, list_max(p)) = list_position(q, list_max(q)))::INT), 6) AS agree FROM n",
    ),
    "blank_frac": (
        lambda s, d: probabilities(s, d).groupBy("label").agg(F.round(F.avg((posterior.best(F.col("p")) == 0).cast("double")), 6).alias("blank")),
        f"SELECT label, round(avg((list_position(p, list_max(p)) = 1)::INT), 6) AS blank FROM ({_SOFT}) GROUP BY label",
    ),
    "masked_accuracy": (
        lambda s, d: metrics.masked_accuracy(t(s, d, "labels").select("quality", F.when(F.col("doc_id") % 5 == 0, -100).otherwise(F.col("toxic")).alias("y")), "quality", "y").select(F.round("accuracy", 6).alias("accuracy")),
        "SELECT round(avg((quality = toxic)::INT) FILTER (WHERE doc_id % 5 != 0), 6) AS accuracy FROM labels",
    ),
    "epoch_ppl": (
        lambda s, d: metrics.epoch_means(t(s, d, "events").select("event_type", (F.col("value") / 100).alias("loss")), "event_type", "loss").select("event_type", F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 6).alias("perplexity")),
        "SELECT event_type, round(avg(value / 100), 6) AS mean_loss, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY event_type",
    ),
    "eval_mean_compat": (
        lambda s, d: metrics.eval_mean(t(s, d, "events"), "value", compat=True).select(F.round("mean_loss", 6).alias("mean_loss")),
        "SELECT round(sum(value) / (count(value) + 1), 6) AS mean_loss FROM events",
    ),
    "running_mean": (
        lambda s, d: metrics.running_mean(t(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean")),
        "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running_mean FROM events",
    ),
    "best_so_far": (
        lambda s, d: metrics.best_so_far(t(s, d, "events").withColumn("acc", -F.col("value")), "user_id", ["ts", "event_id"], "value", "acc").select("event_id", "save"),
        "SELECT event_id, value < coalesce(min(value) OVER w, 'inf'::DOUBLE) OR -value > coalesce(max(-value) OVER w, 0) AS save FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    ),
}


def queries() -> dict:
    return {k: q for k, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOGUE.items() if sql}
