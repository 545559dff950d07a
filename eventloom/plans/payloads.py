"""Payload, record-grid and token queries over the stand-in views."""

from pyspark.sql import functions as F

from eventloom.functions import binary as bn
from eventloom.functions import stats as s
from eventloom.operators import needles as nd
from eventloom.operators import ordered as o
from eventloom.operators import payload as pl
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS

GRID = "WITH g AS (SELECT family, rec_id, pos // 8 AS row, pos % 8 AS off, b FROM {cell})"


def recblk():
    return o.time_block("rec_id", 1 << 14)


@query("D21_payload_entropy", """WITH c AS (SELECT match_id, block_index, b, count(*) AS n FROM {byt} GROUP BY 1, 2, 3), t AS (SELECT match_id, block_index, sum(n) AS bytes, count(*) AS dv FROM c GROUP BY 1, 2),
h AS (SELECT c.match_id, c.block_index, any_value(bytes) AS bytes, any_value(dv) AS dv, -sum(n / bytes * log2(n / bytes)) AS bits, coalesce(sum(n) FILTER (b = 0), 0) / any_value(bytes) AS z FROM c JOIN t USING (match_id, block_index) GROUP BY 1, 2)
SELECT match_id, block_index, CAST(bytes AS BIGINT) AS bytes, dv AS distinct_values, R6(bits) AS bits, R6(z) AS zero_rate, R6(CASE WHEN dv <= 1 THEN 0 ELSE bits / log2(dv) END) AS normalized FROM h""")
def payload_entropy(x):
    keys = ["match_id", "block_index"]
    return pl.entropy(pl.byte_counts(x.pk, keys, "payload"), keys, weight="n")


@query("D22_payload_differential", """WITH r AS (SELECT family, rec_id, arr, lead(arr) OVER (PARTITION BY family ORDER BY rec_id) AS nx FROM {rec}),
e AS (SELECT unnest(range(len(arr))) AS pos, unnest(arr) AS l, unnest(nx) AS r FROM r WHERE nx IS NOT NULL)
SELECT pos, count(*) AS pairs, R6(avg(CASE WHEN l = r THEN 1.0 ELSE 0 END)) AS equal_rate, count(DISTINCT l) AS left_values, count(DISTINCT r) AS right_values FROM e GROUP BY 1 ORDER BY avg(CASE WHEN l = r THEN 1.0 ELSE 0 END) DESC, pairs DESC, pos LIMIT 32""")
def payload_differential(x):
    pairs = o.scan(x.rec, ["family"], ["rec_id"], recblk(), {"nx": o.following("arr")}).filter("nx IS NOT NULL")
    return pl.differential(pairs, "arr", "nx", 32)


@query("D23_byte_ngrams", """WITH g AS (SELECT packet_type, unnest(range(greatest(len - 3, 0))) AS pos, hx FROM {pk}), r AS (SELECT packet_type, pos, substr(hx, CAST(2 * pos + 1 AS BIGINT), 8) AS gram FROM g)
SELECT packet_type, gram, count(*) AS n, count(DISTINCT pos) AS offsets FROM r GROUP BY 1, 2""")
def byte_ngrams(x):
    return pl.ngrams(x.pk, ["packet_type"], "payload", 4)


def _ngram_sql(size):
    return f"""WITH g AS (SELECT packet_type, unnest(range(greatest(len - {size - 1}, 0))) AS pos, hx FROM {{pk}}), r AS (SELECT packet_type, pos, substr(hx, CAST(2 * pos + 1 AS BIGINT), {2 * size}) AS gram FROM g)
SELECT packet_type, gram, count(*) AS n, count(DISTINCT pos) AS offsets FROM r GROUP BY 1, 2"""


@query("D23_byte_ngrams_6", _ngram_sql(6))
def byte_ngrams_6(x):
    return pl.ngrams(x.pk, ["packet_type"], "payload", 6)


@query("D23_byte_ngrams_8", _ngram_sql(8))
def byte_ngrams_8(x):
    return pl.ngrams(x.pk, ["packet_type"], "payload", 8)


@query("D23_byte_counts", "SELECT packet_type, b AS word, count(*) AS n FROM {byt} GROUP BY 1, 2")
def byte_counts(x):
    return x.byt.groupBy("packet_type", F.col("b").alias("word")).agg(F.count("*").alias("n"))


@query("D23_word_counts", """WITH g AS (SELECT packet_type, unnest(range(0, len - 1, 2)) AS pos, hx FROM {pk} WHERE len >= 2), r AS (SELECT packet_type, CAST('0x' || substr(hx, CAST(2 * pos + 3 AS BIGINT), 2) || substr(hx, CAST(2 * pos + 1 AS BIGINT), 2) AS BIGINT) AS word FROM g)
SELECT packet_type, word, count(*) AS n FROM r GROUP BY 1, 2""")
def word_counts(x):
    w = pl.explode_words(x.pk.select("packet_type", "payload"), "payload", 2, 2)
    return w.groupBy("packet_type", "word").agg(F.count("*").alias("n"))


@query("D23_u32_counts", """WITH g AS (SELECT packet_type, unnest(range(0, len - 3, 4)) AS pos, hx FROM {pk} WHERE len >= 4), r AS (SELECT packet_type, CAST('0x' || substr(hx, CAST(2 * pos + 7 AS BIGINT), 2) || substr(hx, CAST(2 * pos + 5 AS BIGINT), 2) || substr(hx, CAST(2 * pos + 3 AS BIGINT), 2) || substr(hx, CAST(2 * pos + 1 AS BIGINT), 2) AS BIGINT) AS word FROM g)
SELECT packet_type, word, count(*) AS n FROM r GROUP BY 1, 2""")
def u32_counts(x):
    w = pl.explode_words(x.pk.select("packet_type", "payload"), "payload", 4, 4)
    return w.groupBy("packet_type", "word").agg(F.count("*").alias("n"))


@query("D23_ngram_examples", """WITH g AS (SELECT packet_type, match_id, block_index, unnest(range(greatest(len - 3, 0))) AS pos, hx FROM {pk}), r AS (SELECT packet_type, match_id, block_index, pos, substr(hx, CAST(2 * pos + 1 AS BIGINT), 8) AS gram FROM g)
SELECT packet_type, gram, match_id, block_index, pos FROM r QUALIFY row_number() OVER (PARTITION BY packet_type, gram ORDER BY match_id, block_index, pos) <= 6""")
def ngram_examples(x):
    """The first six places of every 4-byte gram."""
    rows = pl.gram_rows(x.pk, ["packet_type", "match_id", "block_index"], "payload", 4)
    return o.top_k(rows, ["packet_type", "gram"], [F.asc("match_id"), F.asc("block_index"), F.asc("pos")], 6)


@query("D24_common_prefix", """WITH p AS (SELECT packet_type, pos, min(b) AS lo, max(b) AS hi, count(*) AS n FROM {byt} GROUP BY 1, 2), r AS (SELECT packet_type, max(n) AS rn, max(pos) AS last FROM p GROUP BY 1)
SELECT r.packet_type, coalesce(min(p.pos) FILTER (lo <> hi OR n < rn), any_value(last) + 1) AS prefix FROM r JOIN p USING (packet_type) GROUP BY 1""")
def common_prefix(x):
    return pl.common_prefix(x.byt, ["packet_type"])


@query("D24_stability_map", """WITH c AS (SELECT family, pos, b, count(*) AS n FROM {cell} GROUP BY 1, 2, 3), t AS (SELECT family, pos, max(n) AS top, sum(n) AS al FROM c GROUP BY 1, 2)
SELECT family, pos, CASE WHEN top = al THEN 'X' WHEN top >= 0.08 * al THEN '*' ELSE '.' END AS mark, R6(top / al) AS share FROM t""")
def stability_map(x):
    return pl.stability(x.cell, ["family"], 0.08)


@query("D25_row_grid_columns", GRID + """, a AS (SELECT family, off, count(DISTINCT b) AS dv FROM g GROUP BY 1, 2), r AS (SELECT family, off, row, count(DISTINCT b) AS d FROM g GROUP BY 1, 2, 3), q AS (SELECT family, off, rec_id, count(DISTINCT b) AS d FROM g GROUP BY 1, 2, 3),
r2 AS (SELECT family, off, count(*) FILTER (d = 1) AS cr, max(d) AS mx FROM r GROUP BY 1, 2), q2 AS (SELECT family, off, avg(d) AS md FROM q GROUP BY 1, 2)
SELECT family, off AS "offset", dv AS distinct_values, cr AS constant_rows, mx AS max_row_distinct, R6(md) AS mean_record_distinct, md >= 4 AND cr >= 5 AS discriminator, dv <= 2 AND cr >= 7 AS record_constant FROM a JOIN r2 USING (family, off) JOIN q2 USING (family, off)""")
def row_grid_columns(x):
    return pl.column_profile(pl.grid(x.cell, 8), ["family"], "rec_id", 8)


COH = """WITH r AS (SELECT family, rec_id, arr, lead(arr) OVER (PARTITION BY family ORDER BY rec_id) AS nx FROM {{rec}}),
c AS (SELECT family, rec_id, unnest(range(64)) AS p, unnest(arr) AS a FROM r WHERE nx IS NOT NULL), n AS (SELECT family, rec_id, unnest(range(64)) AS p, unnest(nx) AS b FROM r WHERE nx IS NOT NULL),
d AS (SELECT c.family, c.rec_id, c.p // 8 AS i, n.p // 8 AS j, sum({dist}) AS d FROM c JOIN n ON c.family = n.family AND c.rec_id = n.rec_id AND c.p % 8 = n.p % 8 GROUP BY 1, 2, 3, 4),
m AS (SELECT family, rec_id, i, min(d) AS lo, max(d) FILTER (i = j) AS own FROM d GROUP BY 1, 2, 3), t AS (SELECT m.*, (SELECT count(*) FROM d WHERE d.family = m.family AND d.rec_id = m.rec_id AND d.i = m.i AND d.d = m.lo) AS ties FROM m)
SELECT family, count(*) AS comparisons, count(*) FILTER (own = 0) AS same_row_wins, count(*) FILTER (own = lo) AS at_minimum, count(*) FILTER (ties > 1) AS ambiguous, count(*) FILTER (ties = 1 AND own = lo) AS nearest_wins FROM t GROUP BY 1"""


@query("D26_row_coherence_hamming", COH.format(dist="CASE WHEN a = b THEN 0 ELSE 1 END"))
def row_coherence_hamming(x):
    return pl.row_coherence(x.rec, ["family"], "rec_id", recblk(), "arr", 8, 8, "hamming")


@query("D26_row_coherence_l1", COH.format(dist="abs(a - b)"))
def row_coherence_l1(x):
    return pl.row_coherence(x.rec, ["family"], "rec_id", recblk(), "arr", 8, 8, "l1")


@query("D27_duplicate_rows", """WITH g AS (SELECT family, rec_id, pos // 2 AS row, string_agg(CAST(b // 32 AS VARCHAR), ',' ORDER BY pos) AS h FROM {cell} GROUP BY 1, 2, 3), p AS (SELECT family, rec_id, h, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT family, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicates, R6(coalesce(sum(n) FILTER (n > 1), 0) / sum(n)) AS rate FROM p GROUP BY 1""")
def duplicate_rows(x):
    coarse = x.cell.withColumn("b", F.floor(F.col("b") / 32).cast("long"))
    return pl.duplicate_rows(pl.grid(coarse, 2), ["family"], "rec_id")


@query("D28_column_stats", """WITH d AS (SELECT family, pos, b - 100 AS v, lag(b - 100) OVER (PARTITION BY family, pos ORDER BY rec_id) AS p FROM {cell})
SELECT family, pos, min(v) AS low, max(v) AS high, count(DISTINCT v) AS distinct_values, count(*) FILTER (v = 0) AS zeros, count(*) AS samples, R6(avg(CASE WHEN v BETWEEN 0 AND 20000 THEN 1.0 ELSE 0 END)) AS small_integer,
 R6(avg(CASE WHEN v BETWEEN 0 AND 16000 THEN 1.0 ELSE 0 END)) AS coordinate, R6(CASE WHEN count(p) > 0 THEN count(*) FILTER (v >= p) / count(p) END) AS monotonicity FROM d GROUP BY 1, 2""")
def column_stats(x):
    return pl.column_stats(x.cell.withColumn("v", F.col("b") - 100), ["family", "pos"], ["rec_id"], recblk(), "v")


WORDS4 = """WITH w AS (SELECT match_id, block_index, packet_type, pos, CAST('0x' || substr(hx, CAST(2 * pos + 7 AS BIGINT), 2) || substr(hx, CAST(2 * pos + 5 AS BIGINT), 2) || substr(hx, CAST(2 * pos + 3 AS BIGINT), 2) || substr(hx, CAST(2 * pos + 1 AS BIGINT), 2) AS BIGINT) AS word
 FROM (SELECT *, unnest(range(0, len - 3, {stride})) AS pos FROM {{pk}} WHERE len >= 4))"""


def _words(x, width, stride):
    return pl.explode_words(x.pk.select("match_id", "block_index", "packet_type", "payload"), "payload", width, stride)


@query("C26_token_containment", WORDS4.format(stride=1) + """, ids AS (SELECT DISTINCT CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS word FROM (SELECT hex(encode(text)) AS h FROM {pk}))
, r AS (SELECT match_id, block_index, word AS lit, ((word & 255) << 24) | ((word & 65280) << 8) | ((word >> 8) & 65280) | (word >> 24) AS big FROM w)
SELECT match_id, block_index, count(*) FILTER (lit IN (SELECT word FROM ids)) AS little, count(*) FILTER (big IN (SELECT word FROM ids)) AS big FROM r WHERE lit IN (SELECT word FROM ids) OR big IN (SELECT word FROM ids) GROUP BY 1, 2""")
def token_containment(x):
    """Payloads holding one of the known 32-bit ids (the leading word of every payload), read at every byte in both byte orders."""
    ids = x.pk.select(bn.read_uint("payload", 0, 4).alias("word")).distinct()
    return pl.known_words(x.pk, ["match_id", "block_index"], "payload", ids)


NEEDLES = """WITH p AS (SELECT match_id, block_index, packet_type, text, hx, len FROM {pk}),
v AS (SELECT match_id, block_index + 1 AS participant, unnest(['participant', 'ordinal', 'team', 'champion']) AS kind, unnest([block_index + 1, block_index, 100 + 100 * (block_index % 2), 97 + match_id % 26]) AS v FROM p),
le AS (SELECT match_id, participant, kind, lpad(hex(v & 255), 2, '0') || lpad(hex(v >> 8), 2, '0') || repeat('0', 12) AS le FROM v
 UNION ALL SELECT match_id, block_index + 1, kind, rpad(substr(hx, 1, 2 * w), 16, '0') FROM p, (SELECT unnest(['spell', 'summoner', 'account']) AS kind, unnest([2, 4, 8]) AS w) WHERE len >= w),
n AS (SELECT match_id, participant, kind, 'u' || CAST(8 * w AS VARCHAR) AS width, substr(le, 1, 2 * w) AS needle FROM le, (SELECT unnest([1, 2, 4, 8]) AS w) WHERE substr(le, 2 * w + 1) = repeat('0', 16 - 2 * w)
 UNION ALL SELECT match_id, block_index + 1, unnest(['role', 'name', 'passage']), 'ascii', hex(encode(unnest([packet_type, CASE WHEN length(split_part(text, ' ', 1)) >= 3 THEN split_part(text, ' ', 1) ELSE '' END, CASE WHEN length(text) >= 13 THEN substr(text, 11, 12) ELSE '' END]))) FROM p),
m AS (SELECT *, CAST(length(needle) // 2 AS BIGINT) AS w FROM n WHERE needle <> ''),
g AS (SELECT match_id, pos, w, substr(hx, CAST(2 * pos + 1 AS BIGINT), 2 * w) AS needle FROM (SELECT match_id, hx, w, unnest(range(len - w + 1)) AS pos FROM p, (SELECT DISTINCT w FROM m) WHERE len >= w))
SELECT kind, width, pos AS "offset", count(*) AS hits, count(DISTINCT match_id) AS matches, min(pos - participant) AS least_delta, max(pos - participant) AS most_delta
FROM g JOIN m USING (match_id, w, needle) GROUP BY 1, 2, 3 HAVING count(DISTINCT match_id) >= 2"""


def match_needles(x):
    """Stand-in roster of a match: one participant a turn, with number tokens and texts to look for."""
    turn, p = F.col("block_index"), F.col("payload")
    numbers = {
        "participant": turn + 1, "ordinal": turn, "team": 100 + 100 * (turn % 2), "champion": 97 + F.col("match_id") % 26,
        **{kind: F.when(F.octet_length(p) >= w, F.conv(nd.swapped(F.hex(F.substring(p, 1, w))), 16, 10)) for kind, w in (("spell", 2), ("summoner", 4), ("account", 8))},
    }
    texts = {"role": F.col("packet_type"), "name": F.split_part("text", F.lit(" "), F.lit(1)), "passage": F.when(F.char_length("text") >= 13, F.substring("text", 11, 12))}
    tokens = F.array(
        *[F.struct(F.lit(k).alias("kind"), nd.number_needles(v).alias("n")) for k, v in numbers.items()], *[F.struct(F.lit(k).alias("kind"), nd.text_needles(v).alias("n")) for k, v in texts.items()]
    )
    rows = x.pk.select("match_id", (turn + 1).alias("participant"), F.explode(tokens).alias("k"))
    return rows.select("match_id", "participant", "k.kind", F.explode("k.n").alias("n")).select("match_id", "participant", "kind", "n.width", "n.needle")


@query("C27_needle_search", NEEDLES)
def needle_search(x):
    """Number tokens in 8 to 64 bits and texts from three characters on, at every offset of the payloads of their match.

    Hits are bucketed by kind, width and offset; a bucket needs two matches.
    """
    hits = nd.find_needles(x.pk.select("match_id", "payload"), match_needles(x), ["match_id"])
    delta = F.col("offset") - F.col("participant")
    return hits.groupBy("kind", "width", "offset").agg(
        F.count("*").alias("hits"), F.count_distinct("match_id").alias("matches"), F.min(delta).alias("least_delta"), F.max(delta).alias("most_delta")
    ).filter("matches >= 2")


@query("C28_identifier_hit_rate", """SELECT pos, kind, count(*) AS comparable, count(*) FILTER (b = tok) AS hits, count(DISTINCT family) FILTER (b = tok) AS matches, R6(count(*) FILTER (b = tok) / count(*)) AS hit_rate
FROM (SELECT family, pos, b, unnest(['family', 'mean', 'ordinal']) AS kind, unnest([family + 120, 127, rec_id // 4]) AS tok FROM {cell}) GROUP BY 1, 2 HAVING count(*) FILTER (b = tok) >= 5 AND count(*) FILTER (b = tok) / count(*) >= 0.02""")
def identifier_hit_rate(x):
    """Expected tokens per entity against each field's value; random stand-in bytes hit seldom, so the least rate is low."""
    toks = {"family": F.col("family") + 120, "mean": F.lit(127).cast("long"), "ordinal": F.floor(F.col("rec_id") / 4)}
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("tok")) for k, v in toks.items()])
    rows = x.cell.select("family", "pos", "b", F.explode(arr).alias("t")).select("family", "pos", "b", "t.*")
    return pl.identifier_hits(rows, ["pos", "kind"], "b", "tok", "family", min_support=5, min_rate=0.02)


@query("D69_signature_cooccurrence", """WITH e AS (SELECT *, t // 86400000 AS day, entity || ':' || CAST(k // 20 AS VARCHAR) AS sig FROM {ev}), l AS (SELECT * FROM e WHERE entity = 'purchase'),
p AS (SELECT b.sig, l.event_id, l.day, l.match_id = b.match_id AS own FROM l JOIN e b ON l.day = b.day AND b.entity <> 'purchase' AND abs(l.t - b.t) <= 600000), n AS (SELECT sig, count(*) AS total FROM e GROUP BY 1)
SELECT sig, count(DISTINCT event_id) AS matched_events, count(*) FILTER (own) AS owner_hits, count(DISTINCT day) AS matches, any_value(total) AS total FROM p JOIN n USING (sig) GROUP BY 1""")
def signature_cooccurrence(x):
    """Labels near some block of a signature by interval unions, owner hits by window counts; no pairs are made."""
    e = x.ev.withColumns({"day": tj.bucket("t", DAY_MS), "sig": F.concat_ws(":", "entity", F.floor(F.col("k") / 20).cast("string"))})
    labels, blocks = e.filter("entity = 'purchase'"), e.filter("entity <> 'purchase'")
    near = tj.interval_stats(tj.covered(blocks, ["day", "sig"], "t", 600_000), labels, ["day"], ["sig"], "t", "event_id")
    out = near.filter("n > 0").groupBy("sig").agg(F.sum("n").alias("matched_events"), F.count_distinct("day").alias("matches"))
    spot = F.struct("event_id", "sig").alias("spot")
    own = tj.window_counts(*[side.select("day", "match_id", "t", spot) for side in (blocks, labels)], ["day", "match_id"], "t", "spot", 600_000, "hits")
    out = out.join(own.groupBy(F.col("spot.sig").alias("sig")).agg(F.sum("hits").alias("owner_hits")), "sig")
    return out.join(e.groupBy("sig").agg(F.count("*").alias("total")), "sig")


KNOWN = (0x65, 0x20, 0x6E, 0x72)  # fixed values: frequent payload bytes


@query("D70_signature_clusters", WORDS4.format(stride=4) + """, h AS (SELECT *, list_sum([CAST(((word >> s) & 255) IN (101, 32, 110, 114) AS INT) for s in [0, 8, 16, 24]]) AS known FROM w)
SELECT packet_type, '0x' || lpad(lower(hex(word)), 8, '0') AS token, count(*) AS n FROM h WHERE known >= 2 AND word <> 0 GROUP BY 1, 2""")
def signature_clusters(x):
    return pl.signature_clusters(_words(x, 4, 4), ["packet_type"], KNOWN, "word")


@query("D72_target_ranking", """WITH g AS (SELECT source, count(*) AS recs, count(*) FILTER (lang <> 'en') AS bg, count(DISTINCT doc_id // 50) AS chunks, avg(n_chars) AS al, sum(length(text) - length(replace(text, 'th', ''))) / 2 AS seqs FROM documents GROUP BY 1),
s AS (SELECT *, CASE WHEN bg = 0 THEN 20 ELSE 0 END AS only_score, least(40, greatest(0, chunks * 3)) AS support, least(40, greatest(0, seqs / recs * 10 / 100)) AS tok FROM g)
SELECT source, R6(only_score + support + tok) AS score, CASE WHEN al <= 2 THEN 'tiny' WHEN only_score + support + tok >= 55 THEN 'primary' WHEN only_score + support + tok >= 30 THEN 'secondary' ELSE 'low' END AS class FROM s""")
def target_ranking(x):
    """Support, token and target-only points per family, then the class."""
    seqs = (F.length("text") - F.length(F.replace("text", F.lit("th"), F.lit("")))) / 2
    g = x.documents.groupBy("source").agg(
        F.count("*").alias("recs"), F.count_if(F.col("lang") != "en").alias("bg"), F.count_distinct(F.floor(F.col("doc_id") / 50)).alias("chunks"), F.avg("n_chars").alias("al"), F.sum(seqs).alias("seqs")
    )
    score = F.when(F.col("bg") == 0, 20).otherwise(0) + s.clamp(F.col("chunks") * 3, 0, 40) + s.clamp(F.col("seqs") / F.col("recs") * 10 / 100, 0, 40)
    cls = F.when(F.col("al") <= 2, "tiny").when(score >= 55, "primary").when(score >= 30, "secondary").otherwise("low")
    return g.select("source", score.alias("score"), cls.alias("class"))


@query("J22_mirror_ranges", """WITH r AS (SELECT family, rec_id, arr || arr[9:40] AS arr FROM {rec}), w AS (SELECT family, rec_id, unnest(range(0, 93)) AS st, arr FROM r),
v AS (SELECT st, string_agg(array_to_string(arr[st + 1:st + 4], ','), ';' ORDER BY rec_id) AS sig, min(array_to_string(arr[st + 1:st + 4], ',')) AS lo, max(array_to_string(arr[st + 1:st + 4], ',')) AS hi FROM w GROUP BY 1),
p AS (SELECT a.st AS left_start, b.st - a.st AS distance FROM v a JOIN v b ON a.sig = b.sig AND a.st < b.st WHERE a.lo <> a.hi),
f AS (SELECT *, CASE WHEN left_start - lag(left_start) OVER (PARTITION BY distance ORDER BY left_start) <= 1 THEN 0 ELSE 1 END AS s FROM p), i AS (SELECT *, sum(s) OVER (PARTITION BY distance ORDER BY left_start) AS run FROM f)
SELECT distance, min(left_start) AS left_start, max(left_start) - min(left_start) + 4 AS length FROM i GROUP BY distance, run""")
def mirror_ranges(x):
    """Records extended by a copy of their middle: the copy must be found as one range."""
    rec = x.rec.withColumn("arr", F.concat("arr", F.slice("arr", 9, 32)))
    return pl.mirror_ranges(rec, "arr", 4)


@query("J23_bitmap_falsification", """WITH c AS (SELECT rec_id, pos, b, lag(b) OVER (PARTITION BY family, pos ORDER BY rec_id) AS p FROM {cell} WHERE pos >= 8), m AS (SELECT rec_id, arr FROM {rec}),
s AS (SELECT unnest([0, 0, 1, 1]) AS lsb, unnest([0, 1, 0, 1]) AS inv),
t AS (SELECT lsb, inv, ((arr[(pos - 8) // 8 + 1] >> CASE WHEN lsb = 1 THEN (pos - 8) % 8 ELSE 7 - (pos - 8) % 8 END) & 1) <> inv AS pred, b <> p AS act FROM c JOIN m USING (rec_id), s WHERE p IS NOT NULL)
SELECT lsb, inv, count(*) FILTER (pred AND act) AS tp, count(*) FILTER (pred AND NOT act) AS fp, count(*) FILTER (NOT pred AND act) AS fn, count(*) FILTER (NOT pred AND NOT act) AS tn, bool_and(pred = act) AS exact FROM t GROUP BY 1, 2""")
def bitmap_falsification(x):
    """Is there a leading change bitmap? Every bit order and inversion is scored against real changes."""
    rec = o.scan(x.rec, ["family"], ["rec_id"], recblk(), {"before": o.prev("arr")}).filter("before IS NOT NULL")
    size = F.size("arr")
    slots = F.transform(F.sequence(F.lit(8), size - 1), lambda i: F.struct((i - 8).alias("slot"), (F.element_at("arr", i + 1) != F.element_at("before", i + 1)).alias("act")))
    rows = rec.select(F.slice("arr", 1, 8).alias("bits"), F.explode(slots).alias("s")).select("bits", "s.*")
    spec = F.array(*[F.struct(F.lit(a).cast("long").alias("lsb"), F.lit(b).cast("long").alias("inv")) for a in (0, 1) for b in (0, 1)])
    rows = rows.withColumn("spec", F.explode(spec)).select("bits", "slot", "act", "spec.*")
    byte = F.element_at("bits", (F.floor(F.col("slot") / 8) + 1).cast("int"))
    at = F.pmod("slot", F.lit(8))
    bit = F.when(F.col("lsb") == 1, F.expr("shiftright(element_at(bits, int(floor(slot / 8)) + 1), slot % 8)")).otherwise(
        F.expr("shiftright(element_at(bits, int(floor(slot / 8)) + 1), 7 - slot % 8)")
    ).bitwiseAND(F.lit(1))
    pred = bit != F.col("inv")
    act = F.col("act")
    return rows.groupBy("lsb", "inv").agg(
        F.count_if(pred & act).alias("tp"), F.count_if(pred & ~act).alias("fp"), F.count_if(~pred & act).alias("fn"), F.count_if(~pred & ~act).alias("tn"), F.bool_and(pred == act).alias("exact")
    )


@query("J24_grid_hypotheses", """SELECT packet_type, len, row_count, header, CAST((len - header) // row_count AS BIGINT) AS row_size FROM (SELECT DISTINCT packet_type, len FROM {pk}), (SELECT unnest([10, 5]) AS row_count), (SELECT unnest(range(17)) AS header)
WHERE len > header AND (len - header) % row_count = 0 AND (len - header) // row_count BETWEEN 4 AND 128""")
def grid_hypotheses(x):
    return pl.grid_hypotheses(x.pk.select("packet_type", "len").distinct(), "len")


HANDLE = """WITH w AS (SELECT family, pos % 8 AS off, pos // 8 AS row, rec_id, b AS word FROM {cell}), d AS (SELECT family AS target, 118 + family AS row_count FROM (SELECT DISTINCT family FROM {cell})),
e AS (SELECT w.family, off AS "offset", target, count(*) AS n, count(DISTINCT rec_id) AS matches, count(DISTINCT row) AS source_rows, count(DISTINCT word) AS target_rows FROM w JOIN d ON word > 0 AND word < row_count GROUP BY 1, 2, 3)"""


def _edges(x):
    w = pl.grid(x.cell.withColumnRenamed("b", "word"), 8)
    dims = x.cell.select("family").distinct().withColumn("row_count", F.col("family") + 118)
    return pl.handle_edges(w, "family", "offset", "word", dims, "rec_id", "row")


@query("J37_handle_graph_edges", HANDLE + ' SELECT family, "offset", target, n, matches, source_rows, target_rows FROM e')
def handle_graph_edges(x):
    return _edges(x)


@query("D73_handle_pattern_score", HANDLE + """, c AS (SELECT count(DISTINCT rec_id) AS corpus FROM {cell})
SELECT family, "offset", target, R6(0.18 * least(1, matches / corpus) + 0.30 * least(1, matches / 2 / corpus) + 0.20 * 0.5 + 0.16 * (1 - least(1, greatest(0, (source_rows - 1) / 24))) + 0.04 - 0.10 * least(1, greatest(0, (source_rows - 10) / 40)) - 0.10 * least(1, greatest(0, (target_rows - 10) / 40))
 - 0.08 * 0.5 - CASE WHEN family = target THEN 0.08 ELSE 0 END) AS score, concat_ws(',', CASE WHEN source_rows > 6 THEN 'row-specificity' END, CASE WHEN matches < 4 THEN 'match-support' END) AS blockers FROM e, c""")
def handle_pattern_score(x):
    from eventloom.operators.rollups import reasons

    corpus = x.cell.agg(F.count_distinct("rec_id").alias("corpus"))
    e = _edges(x).crossJoin(F.broadcast(corpus))  # one-row side
    c = F.col
    cov = s.clamp(c("matches") / c("corpus"))
    half = s.clamp(c("matches") / 2 / c("corpus"))
    score = pl.handle_pattern_score(cov, half, F.lit(0.5), c("source_rows"), c("source_rows"), c("target_rows"), F.lit(0.5), 4, c("family") == c("target"))
    why = reasons(row_specificity=c("source_rows") > 6, match_support=c("matches") < 4)
    return e.select("family", "offset", "target", score.alias("score"), F.array_join(why, ",").alias("blockers"))


@query("J41_cleaned_rows", """WITH s AS (SELECT family, pos // 4 AS slot, count(DISTINCT b) AS dv, avg(b) AS m FROM {cell} GROUP BY 1, 2), d AS (SELECT family, slot FROM s QUALIFY row_number() OVER (PARTITION BY family ORDER BY dv DESC, slot) <= 8),
m AS (SELECT family, slot FROM s QUALIFY row_number() OVER (PARTITION BY family ORDER BY m DESC, slot) <= 6), u AS (SELECT DISTINCT family, slot FROM (SELECT * FROM d UNION ALL SELECT * FROM m))
SELECT family, slot FROM u QUALIFY row_number() OVER (PARTITION BY family ORDER BY slot) <= 10""")
def cleaned_rows(x):
    sl = x.cell.groupBy("family", F.floor(F.col("pos") / 4).alias("slot")).agg(F.count_distinct("b").alias("dv"), F.avg("b").alias("m"))
    d = o.top_k(sl, ["family"], [F.desc("dv"), F.asc("slot")], 8).select("family", "slot")
    m = o.top_k(sl, ["family"], [F.desc("m"), F.asc("slot")], 6).select("family", "slot")
    return o.top_k(d.union(m).distinct(), ["family"], [F.asc("slot")], 10)


LANES = f"""WITH l AS (SELECT family, rec_id, pos // 4 AS lane, sum(b << (8 * (pos % 4))) AS raw FROM {{cell}} GROUP BY 1, 2, 3),
dec1 AS (SELECT * FROM (SELECT family, rec_id, lane, {bn.lane_decodes_sql("raw")} FROM (SELECT * REPLACE (CAST(raw AS BIGINT) AS raw) FROM l)) WHERE abs(decoded) < 1e9 OR decode <> 'f32')"""
FIELDS = """, q AS (SELECT *, lag(decoded) OVER (PARTITION BY family, lane, decode ORDER BY rec_id) AS p FROM {src})
SELECT family, lane, decode, count(*) AS samples, count(*) FILTER (decoded <> 0) AS active, count(DISTINCT decoded) AS unique_values, count(*) FILTER (p IS NOT NULL AND decoded <> p) AS changed, R6(min(decoded)) AS low, R6(max(decoded)) AS high FROM q GROUP BY 1, 2, 3 HAVING count(*) FILTER (decoded <> 0) >= 4"""


#: Float readings that are not numbers of a usual size mean nothing.
PLAIN = "abs(decoded) < 1e9 OR decode <> 'f32'"


def _lanes(x):
    """32-bit little-endian lanes of each record with all decodes."""
    word = [F.element_at("arr", (F.col("lane") * 4 + i + 1).cast("int")) for i in range(4)]
    raw = word[0] + word[1] * 256 + word[2] * 65536 + word[3] * 16777216
    lanes = x.rec.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.size("arr") / 4) - 1)))
    lanes = lanes.select("family", "rec_id", "lane", raw.alias("raw"))
    return lanes.select("family", "rec_id", "lane", "raw", F.explode(bn.lane_decodes("raw")).alias("d")).select("family", "rec_id", "lane", "raw", "d.*")


@query("J43_row_offset_fields", LANES + FIELDS.format(src="dec1"))
def row_offset_fields(x):
    lanes = _lanes(x).filter(PLAIN)
    return pl.row_offset_fields(lanes, ["family", "lane", "decode"], ["rec_id"], recblk(), 4)


@query("J55_clean_row_offset_fields", LANES + """, sig AS (SELECT family, lane FROM l GROUP BY 1, 2 HAVING max((CAST(raw AS BIGINT) & 255)) - min(CAST(raw AS BIGINT) & 255) <= 50),
keep AS (SELECT dec1.* FROM dec1 ANTI JOIN sig ON dec1.family = sig.family AND dec1.lane = sig.lane)""" + FIELDS.format(src="keep"))
def clean_row_offset_fields(x):
    """As the row-offset scan, after dropping marker lanes: first byte within a span of 50 (our rule)."""
    lanes = _lanes(x).filter(PLAIN)
    first = F.col("raw").bitwiseAND(F.lit(255))
    sig = lanes.filter("decode = 'u32'").groupBy("family", "lane").agg((F.max(first) - F.min(first)).alias("sp")).filter("sp <= 50")
    keep = lanes.join(sig, ["family", "lane"], "left_anti")
    return pl.row_offset_fields(keep, ["family", "lane", "decode"], ["rec_id"], recblk(), 4)


@query("J56_handle_link_counts", """WITH d AS (SELECT family AS target, count(*) AS row_count FROM {rec} GROUP BY 1) SELECT c.family, pos, target, count(*) AS n FROM {cell} c JOIN d ON c.b = d.row_count + 60 AND c.family <> d.target GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY c.family ORDER BY count(*) DESC, pos, target) <= 10""")
def handle_link_counts(x):
    dims = x.rec.groupBy(F.col("family").alias("target")).agg((F.count("*") + 60).alias("b"))
    hit = x.cell.join(dims, "b").filter("family <> target").groupBy("family", "pos", "target").agg(F.count("*").alias("n"))
    return o.top_k(hit, ["family"], [F.desc("n"), F.asc("pos"), F.asc("target")], 10)


SLICES = """, s AS (SELECT packet_type, word, unnest([0, 8, 16, 24, 0, 16, 0, 4, 8, 12, 16, 20]) AS "start", unnest([8, 8, 8, 8, 16, 16, 12, 12, 12, 12, 12, 12]) AS bits FROM w),
v AS (SELECT packet_type, "start", bits, (word >> "start") & ((1 << bits) - 1) AS slice FROM s)"""


@query("J57_token_bitfields", WORDS4.format(stride=4) + SLICES + """, kn AS (SELECT DISTINCT len AS slice FROM {pk}) SELECT packet_type, "start", bits, count(*) AS hits, count(DISTINCT slice) AS known_values FROM v SEMI JOIN kn USING (slice) GROUP BY 1, 2, 3""")
def token_bitfields(x):
    """Bit windows of every token against the known counts (payload lengths)."""
    sl = _words(x, 4, 4).select("packet_type", F.explode(bn.token_windows("word")).alias("w")).select("packet_type", "w.*")
    sl = sl.groupBy("packet_type", "start", "bits", "slice").agg(F.count("*").alias("n"))
    known = x.pk.select(F.col("len").alias("slice")).distinct()
    return sl.join(known, "slice", "left_semi").groupBy("packet_type", "start", "bits").agg(F.sum("n").alias("hits"), F.count("*").alias("known_values"))


@query("J58_stride_guess", """WITH r AS (SELECT packet_type, list(b ORDER BY pos) AS arr FROM {byt} GROUP BY match_id, block_index, packet_type),
q AS (SELECT packet_type, lag, list_sum(list_transform(range(1, len(arr) - lag + 1), lambda i: CAST(arr[i] = arr[i + lag] AS INT))) AS h, len(arr) - lag AS m FROM r, (SELECT unnest(range(1, 17)) AS lag) WHERE len(arr) > lag),
a AS (SELECT packet_type, lag, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(m) AS BIGINT) AS n FROM q GROUP BY 1, 2)
SELECT packet_type, lag, hits, n, R6(hits / n) AS agreement FROM a QUALIFY row_number() OVER (PARTITION BY packet_type ORDER BY hits / n DESC, lag) = 1""")
def stride_guess(x):
    rec = x.pk.select("packet_type", bn.bytes_array("payload").alias("arr"))
    return pl.stride_guess(rec, ["packet_type"], "arr", range(1, 17))


@query("J59_event_window_match", """WITH c AS (SELECT match_id, entity, event_id, t // 21600000 AS chunk, x, y FROM (SELECT e.entity, g.* FROM {tgt} g JOIN {ev} e USING (event_id))), v AS (SELECT * FROM c WHERE entity = 'error'), s AS (SELECT * FROM c WHERE entity <> 'error')
SELECT v.event_id, s.event_id AS candidate, R6(sqrt(power(v.x - s.x, 2) + power(v.y - s.y, 2))) AS distance FROM v JOIN s ON v.match_id = s.match_id AND abs(v.chunk - s.chunk) <= 1 QUALIFY row_number() OVER (PARTITION BY v.event_id ORDER BY power(v.x - s.x, 2) + power(v.y - s.y, 2), s.event_id) <= 3""")
def event_window_match(x):
    """Candidates closest to an event's position within one chunk of it."""
    c = x.tgt.join(x.ev.select("event_id", "entity"), "event_id").withColumn("chunk", tj.bucket("t", 21_600_000))
    v = c.filter("entity = 'error'").withColumn("chunk", F.explode(F.array(*[F.col("chunk") + d for d in (-1, 0, 1)])))
    sl = c.filter("entity <> 'error'").select("match_id", "chunk", F.col("event_id").alias("candidate"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    d2 = F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0))
    hit = v.join(sl, ["match_id", "chunk"]).withColumn("d2", d2)
    return o.top_k(hit, ["event_id"], [F.asc("d2"), F.asc("candidate")], 3).select("event_id", "candidate", F.sqrt("d2").alias("distance"))


@query("J60_sparse_slot_trace", "SELECT family, rec_id, pos, b FROM {cell} WHERE b < 90 QUALIFY row_number() OVER (PARTITION BY family ORDER BY rec_id, pos) <= 12")
def sparse_slot_trace(x):
    """First twelve sparse values per family, in record order (the trace length is the feature)."""
    return o.top_k(x.cell.filter("b < 90"), ["family"], [F.asc("rec_id"), F.asc("pos")], 12)


@query("J60_family_prefix_compare", """WITH p AS (SELECT lang, hex(encode(substr(text, 1, 3))) AS prefix, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT lang, sum(n) AS total, max(n) AS top FROM p GROUP BY 1)
SELECT lang, count(*) AS prefixes, CAST(any_value(total) AS BIGINT) AS total, any_value(top) AS top FROM p JOIN t USING (lang) GROUP BY 1""")
def family_prefix_compare(x):
    """Prefix census of each family; the prefix is the compared feature, the texts stay whole elsewhere."""
    p = x.documents.groupBy("lang", F.hex(F.encode(F.substring("text", 1, 3), "UTF-8")).alias("prefix")).agg(F.count("*").alias("n"))
    return p.groupBy("lang").agg(F.count("*").alias("prefixes"), F.sum("n").alias("total"), F.max("n").alias("top"))
