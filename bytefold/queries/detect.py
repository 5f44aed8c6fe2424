"""Queries of the detection algorithms: the registered operators over whole texts and vector images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.crypto import CHECK_IV
from bytefold.operators import results
from bytefold.operators.algorithms import REGISTRY, Context, run_all
from bytefold.operators.chunks import chunked
from bytefold.operators.structures import Field, Structure, apply_structure
from bytefold.operators.verification import VERIFIERS, first_verified
from bytefold.queries.images import _BYTES, _SETS, _VEC, NEEDLES, _con, _hits, _sliding, ascii_strings, consensus_by_set, consensus_variance, texts, vector_images

#: Structures for the texts: the scores of their constrained fields differ from place to place.
STRUCTURES = [
    Structure("spaced", 24, (Field("blank", "uint8", 0, 1, {"equals": 32}), Field("letter", "uint8", 8, 1, {"min": 97, "max": 122}), Field("rest", "bytes", 9, 15))),
    Structure("digit", 12, (Field("first", "uint8", 0, 1, {"min": 48, "max": 57}), Field("pair", "uint16_be", 2, 2, {"max": 0x6000}))),
]
_RULES = {"before": [{"offset": -1, "bytes": "20"}], "after": [{"offset": 32, "bytes": "20", "mask": "df"}]}


def _run(name: str, images: DataFrame, secrets=(), **extra) -> DataFrame:
    return REGISTRY[name].run(images, Context(secrets=list(secrets), extra=extra)).withColumn("confidence", F.round("confidence", 4))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).filter("data is not null")


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of the known values and the share of them that each text holds."""
    return _run("exact_match", _texts(spark, d), NEEDLES)


def entropy_scan(spark: SparkSession, d: str) -> DataFrame:
    """High-entropy windows of the texts, overlaps merged."""
    return _run("entropy_scan", _texts(spark, d), entropy_threshold=4.4)


def change_point(spark: SparkSession, d: str) -> DataFrame:
    """Key-wide entropy plateaus of the texts."""
    return _run("change_point", _texts(spark, d), entropy_threshold=3.5)


def structure_scan(spark: SparkSession, d: str) -> DataFrame:
    """Structures at the places of the texts where they are looked for."""
    return _run("structure_scan", _texts(spark, d), entropy_threshold=4.0, structures=STRUCTURES)


def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    """Candidates after a blank that are followed by one."""
    pattern = {"name": "between_blanks", "key_spec": {"length": 32, "entropy_min": 4.2}, "pattern": _RULES}
    return _run("pattern_match", _texts(spark, d), patterns=[pattern])


def differential(spark: SparkSession, d: str) -> DataFrame:
    """Key-wide regions that vary within each capture set."""
    return _run("differential", vector_images(spark, d).select("dump_id", "grp", "data"))


def user_regex(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the user's patterns as detections."""
    return _run("user_regex", _texts(spark, d), patterns=[("address", "0x[0-9a-f]+")])


def algorithm_hits(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each of three algorithms."""
    context = Context(secrets=NEEDLES, extra={"patterns": [("address", "0x[0-9a-f]+")], "entropy_threshold": 4.4})
    return results.counts_by_algorithm(run_all(_texts(spark, d), context, ["exact_match", "user_regex", "entropy_scan"]))


def first_matches(spark: SparkSession, d: str) -> DataFrame:
    """The first three places of the needles in each text."""
    return results.first_of_each(exact_match(spark, d), ["dump_id"], ["off", "label"], 3)


def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """The twenty matches of highest confidence."""
    return results.best_first(entropy_scan(spark, d)).limit(20)


def strings_containing(spark: SparkSession, d: str) -> DataFrame:
    """Strings that hold a word, whatever its case."""
    return results.containing(ascii_strings(spark, d), "SESSION").select("dump_id", "off", "length")


def class_range(spark: SparkSession, d: str) -> DataFrame:
    """Classes of a range of offsets over all vector images."""
    return results.class_range(consensus_variance(spark, d), 8, 24)


def byte_shares(spark: SparkSession, d: str) -> DataFrame:
    """Static and dynamic offsets of each capture set."""
    return results.byte_shares(consensus_by_set(spark, d), ["grp"])


_PLAIN = b"a plaintext that the tool knows"


def verified_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per vector image the first 8-aligned place whose 32 bytes decrypt what was sealed by image 7."""
    images = vector_images(spark, d)
    key = F.substring("data", 17, 32)
    sealed = images.filter("dump_id = 7").select(VERIFIERS["AES-256-CBC"].seal(key, F.lit(_PLAIN), CHECK_IV)).first()
    places = images.select("dump_id", F.explode(F.array(*(F.lit(o).cast("bigint") for o in range(0, 48, 8)))).alias("off"))
    return first_verified(chunked(images, 31), places, bytes(sealed[0]) if sealed else b"", _PLAIN)


def structure_at(spark: SparkSession, d: str) -> DataFrame:
    """A structure laid over two places of each text."""
    at = _texts(spark, d).select("dump_id", F.explode(F.array(F.lit(0), F.lit(70000))).alias("off"))
    return apply_structure(chunked(_texts(spark, d), 64), at, "spaced", STRUCTURES).select("dump_id", "off", "structure", "size", "confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (exact_match, entropy_scan, change_point, structure_scan, pattern_match, differential, user_regex, algorithm_hits, first_matches, best_matches, strings_containing, class_range, byte_shares, verified_keys, structure_at)}


def _windows(step: int, *sizes: int) -> str:
    """Entropy of all windows of the texts: ``pro(dump_id, w, off, e)``."""
    each = " UNION ALL ".join(f"SELECT doc_id AS dump_id, {w} AS w, off, e FROM sli{w} WHERE off % {step} = 0" for w in sizes)
    return f"siz AS (SELECT doc_id, count(*) AS n FROM byt GROUP BY 1), {', '.join(_sliding(w, f'sli{w}') for w in sizes)}, pro AS ({each})"


def _merged(least: float) -> str:
    """The fold over overlapping candidates, cluster by cluster: ``kep(dump_id, off, len, conf)``."""
    return f"""can AS (SELECT dump_id, off, w, round(e, 9) / 8 AS conf FROM pro WHERE e >= {least}),
ord AS (SELECT *, coalesce(max(off + w) OVER (PARTITION BY dump_id ORDER BY off, w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, row_number() OVER (PARTITION BY dump_id ORDER BY off, w DESC) AS i FROM can),
clu AS (SELECT *, sum(CASE WHEN off >= top THEN 1 ELSE 0 END) OVER (PARTITION BY dump_id ORDER BY i) AS c FROM ord),
lis AS (SELECT dump_id, c, list({{'off': off, 'len': w, 'conf': conf, 'kept': CAST([] AS STRUCT(off BIGINT, len INTEGER, conf DOUBLE)[])}} ORDER BY i) AS l FROM clu GROUP BY 1, 2),
fol AS (SELECT dump_id, list_reduce(l, lambda a, x: CASE WHEN x.off >= a.off + a.len THEN {{'off': x.off, 'len': x.len, 'conf': x.conf, 'kept': list_append(a.kept, {{'off': a.off, 'len': CAST(a.len AS INTEGER), 'conf': a.conf}})}}
  WHEN x.conf > a.conf THEN {{'off': x.off, 'len': x.len, 'conf': x.conf, 'kept': a.kept}} ELSE a END) AS r FROM lis),
kep AS (SELECT dump_id, unnest(list_append(r.kept, {{'off': r.off, 'len': CAST(r.len AS INTEGER), 'conf': r.conf}}), recursive := true) FROM fol)"""


_CUSUM = """dif AS (SELECT dump_id, off, e - lag(e) OVER (PARTITION BY dump_id ORDER BY off) AS d, first_value(off) OVER (PARTITION BY dump_id ORDER BY off) AS z FROM pro),
acc AS (SELECT dump_id, list({'off': off, 'd': coalesce(d, 0.0), 'up': 0.0::DOUBLE, 'dn': 0.0::DOUBLE, 'ou': z, 'od': z, 'out': CAST([] AS STRUCT(o BIGINT, up BOOLEAN, s DOUBLE)[])} ORDER BY off) AS l FROM dif GROUP BY 1),
s1 AS (SELECT dump_id, list_reduce(l, lambda a, x: {'off': x.off, 'd': x.d,
    'up': CASE WHEN greatest(0, a.up + x.d - 0.05) > 0.8 THEN 0.0 ELSE greatest(0, a.up + x.d - 0.05) END,
    'dn': CASE WHEN greatest(0, a.dn - x.d - 0.05) > 0.8 THEN 0.0 ELSE greatest(0, a.dn - x.d - 0.05) END,
    'ou': CASE WHEN a.up = 0 AND a.up + x.d - 0.05 > 0 THEN x.off ELSE a.ou END,
    'od': CASE WHEN a.dn = 0 AND a.dn - x.d - 0.05 > 0 THEN x.off ELSE a.od END,
    'out': list_concat(a.out, list_concat(
      CASE WHEN a.up + x.d - 0.05 > 0.8 THEN [{'o': CASE WHEN a.up = 0 THEN x.off ELSE a.ou END, 'up': true, 's': a.up + x.d - 0.05}] ELSE [] END,
      CASE WHEN a.dn - x.d - 0.05 > 0.8 THEN [{'o': CASE WHEN a.dn = 0 THEN x.off ELSE a.od END, 'up': false, 's': a.dn - x.d - 0.05}] ELSE [] END))}).out AS edges FROM acc),
s2 AS (SELECT dump_id, list_transform(edges, lambda x: {'o': x.o, 'up': x.up, 's': x.s, 'free': true, 'out': CAST([] AS STRUCT(a BIGINT, b BIGINT, s DOUBLE)[])}) AS l FROM s1 WHERE len(edges) > 1),
s3 AS (SELECT dump_id, unnest(list_reduce(l, lambda a, x: CASE WHEN a.free AND a.up AND NOT x.up THEN {'o': x.o, 'up': x.up, 's': x.s, 'free': false, 'out': list_append(a.out, {'a': a.o, 'b': x.o, 's': (a.s + x.s) / 2})}
   ELSE {'o': x.o, 'up': x.up, 's': x.s, 'free': true, 'out': a.out} END).out, recursive := true) FROM s2),
fit AS (SELECT dump_id, a, b, s, arg_min(w, (abs(b - a - span), n)) AS w, min(abs(b - a - span)) AS far FROM s3, (SELECT unnest([32, 32, 48, 48]) AS w, unnest([32, 63, 48, 79]) AS span, unnest([0, 1, 2, 3]) AS n) GROUP BY dump_id, a, b, s HAVING b > a AND min(abs(b - a - span)) <= 16)"""


def oracle_sql() -> dict[str, str]:
    merged = f"WITH {_BYTES}, {_windows(1, 32, 48)}, {_merged(4.4)}"
    at = "LEFT JOIN byt {n} ON {n}.doc_id = k.dump_id AND {n}.off = k.off + {o}"
    out = _algorithms(merged, at)
    strings = f"WITH {_BYTES}, p AS (SELECT *, off - row_number() OVER (PARTITION BY doc_id ORDER BY off) AS g FROM byt WHERE v BETWEEN 32 AND 126 OR v IN (9, 10, 13))"
    return out | {
        "algorithm_hits": " UNION ALL ".join(f"SELECT '{n}' AS algorithm, count(*) AS hits FROM ({out[n]})" for n in ("exact_match", "user_regex", "entropy_scan")),
        "first_matches": f"SELECT * FROM ({out['exact_match']}) QUALIFY row_number() OVER (PARTITION BY dump_id ORDER BY off, label) <= 3",
        "best_matches": f"SELECT * FROM ({merged} SELECT dump_id, off, len AS length, round(conf, 4) AS confidence, concat('high_entropy_', len, 'B') AS label FROM kep) ORDER BY confidence DESC, dump_id, off, length LIMIT 20",
        "strings_containing": f"{strings} SELECT doc_id AS dump_id, min(off) AS off, CAST(count(*) AS INTEGER) AS length FROM p GROUP BY doc_id, g HAVING count(*) >= 4 AND contains(lower(string_agg(chr(CAST(v AS INTEGER)), '' ORDER BY off)), 'session')",
        "class_range": f"WITH {_VEC}, {_con('')} SELECT off, class FROM con WHERE off BETWEEN 8 AND 31",
        "byte_shares": f"{_SETS} SELECT grp, count(*) FILTER (WHERE variance <= 2000) AS static, count(*) FILTER (WHERE variance > 2000) AS dynamic FROM con GROUP BY 1",
        "verified_keys": f"WITH {_VEC} SELECT vec_id AS dump_id, CAST(16 AS BIGINT) AS off, string_agg(format('{{:02x}}', v), '' ORDER BY off) AS key_hex, 'AES-256-CBC' AS cipher FROM vec WHERE vec_id = 7 AND off BETWEEN 16 AND 47 GROUP BY 1",
        "structure_at": f"WITH {_BYTES} SELECT a.doc_id AS dump_id, a.off, 'spaced' AS structure, 24 AS size, ((a.v = 32)::INT + coalesce(b.v BETWEEN 97 AND 122, false)::INT) / 2 AS confidence FROM byt a LEFT JOIN byt b ON b.doc_id = a.doc_id AND b.off = a.off + 8 WHERE a.off IN (0, 70000)",
    }


def _algorithms(merged: str, at: str) -> dict[str, str]:
    return {
        "exact_match": f"WITH {_BYTES}, hits AS ({_hits()}) SELECT dump_id, off, length, round(c / {len(NEEDLES)}, 4) AS confidence, secret_type AS label FROM hits JOIN (SELECT dump_id, count(DISTINCT secret_type) AS c FROM hits GROUP BY 1) USING (dump_id)",
        "entropy_scan": merged + " SELECT dump_id, off, len AS length, round(conf, 4) AS confidence, concat('high_entropy_', len, 'B') AS label FROM kep",
        "change_point": f"""WITH {_BYTES}, {_windows(16, 32)}, {_CUSUM},
mea AS (SELECT f.dump_id, a, b, any_value(s) AS s, any_value(f.w) AS w, avg(e) AS m FROM fit f JOIN pro p ON p.dump_id = f.dump_id AND off BETWEEN a AND b GROUP BY 1, 2, 3 HAVING avg(e) >= 3.5)
SELECT dump_id, a AS off, CAST(least(m.w, n - a) AS INTEGER) AS length, round(round(least(m / 8, 1.0) * least(s / 3, 1.0), 4), 4) AS confidence, concat('cusum_plateau_', least(m.w, n - a), 'B') AS label FROM mea m JOIN siz ON doc_id = dump_id""",
        "pattern_match": f"""WITH {_BYTES}, {_windows(1, 32)}, {_merged(4.2)}
SELECT k.dump_id, k.off, 32 AS length, (CASE WHEN x.v = 32 THEN 0.5 ELSE 0 END + CASE WHEN y.v & 223 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS confidence, 'between_blanks' AS label FROM kep k {at.format(n='x', o='(-1)')} {at.format(n='y', o='32')} WHERE x.v = 32 OR y.v & 223 = 0""",
        "structure_scan": f"""WITH {_BYTES}, {_windows(16, 32)}, lst AS (SELECT dump_id, max(off) AS last FROM pro GROUP BY 1),
reg AS (SELECT dump_id, start, least(stop, last) AS stop FROM (SELECT dump_id, min(off) AS start, max(off) + 16 AS stop FROM (SELECT *, off // 16 - row_number() OVER (PARTITION BY dump_id ORDER BY off) AS g FROM pro WHERE e >= 4.0) GROUP BY dump_id, g) JOIN lst USING (dump_id) WHERE least(stop, last) - start >= 32),
k AS (SELECT dump_id, unnest(generate_series(start, stop - 1, 16)) AS off FROM reg UNION SELECT doc_id, unnest(generate_series(0, least(n, 1024) - 1, 64)) FROM siz WHERE n >= 32),
sco AS (SELECT k.dump_id, k.off, s.n, coalesce(a.v = 32, false)::INT + coalesce(b.v BETWEEN 97 AND 122, false)::INT AS p, coalesce(a.v BETWEEN 48 AND 57, false)::INT + coalesce(c.v * 256 + d.v <= 24576, false)::INT AS q
  FROM k JOIN siz s ON s.doc_id = k.dump_id {at.format(n='a', o='0')} {at.format(n='b', o='8')} {at.format(n='c', o='2')} {at.format(n='d', o='3')}),
bes AS (SELECT *, CASE WHEN off + 24 <= n THEN p ELSE 0 END AS p1, CASE WHEN off + 12 <= n THEN q ELSE 0 END AS q1 FROM sco)
SELECT dump_id, off, CASE WHEN p1 >= q1 THEN 24 ELSE 12 END AS length, CAST(greatest(p1, q1) / 2 AS DOUBLE) AS confidence, CASE WHEN p1 >= q1 THEN 'struct:spaced' ELSE 'struct:digit' END AS label FROM bes WHERE greatest(p1, q1) > 0""",
        "differential": f"""{_SETS}, r AS (SELECT grp, min(off) AS start, max(off) + 1 AS stop FROM (SELECT *, off - row_number() OVER (PARTITION BY grp ORDER BY off) AS g FROM con WHERE class = 3 AND n >= 2) GROUP BY grp, g),
g AS (SELECT *, lag(stop) OVER (PARTITION BY grp ORDER BY start) AS pe FROM r),
f AS (SELECT *, CASE WHEN pe IS NULL OR start - pe > 4 OR EXISTS (SELECT 1 FROM con c WHERE c.grp = g.grp AND c.class = 0 AND c.off >= g.pe AND c.off < g.start) THEN 1 ELSE 0 END AS nw FROM g),
m AS (SELECT grp, min(start) AS off, max(stop) - min(start) AS len FROM (SELECT *, sum(nw) OVER (PARTITION BY grp ORDER BY start) AS k FROM f) GROUP BY grp, k),
w AS (SELECT m.grp, m.off, len, avg(variance) AS mv, least(abs(len - 32), abs(len - 48)) AS far FROM m JOIN con c ON c.grp = m.grp AND c.off >= m.off AND c.off < m.off + len WHERE least(abs(len - 32), abs(len - 48)) <= 8 GROUP BY ALL)
SELECT (SELECT min(vec_id) FROM embeddings e WHERE e.vec_id // 3 = w.grp) AS dump_id, off, CAST(len AS INTEGER) AS length, round(0.7 * least(mv / 8000, 1.0) + 0.3 * greatest(1 - far / 8, 0), 4)::DOUBLE AS confidence, concat('diff_key_candidate_', len, 'B') AS label FROM w""",
        "user_regex": """WITH m AS (SELECT doc_id, regexp_extract_all(text, '0x[0-9a-f]+') AS m, regexp_split_to_array(text, '0x[0-9a-f]+') AS p FROM documents WHERE regexp_matches(text, '0x[0-9a-f]+')),
u AS (SELECT doc_id, unnest(m) AS x, unnest(p[:len(m)]) AS b, generate_subscripts(m, 1) AS i FROM m)
SELECT doc_id AS dump_id, CAST(sum(strlen(b) + strlen(x)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(x) AS BIGINT) AS off, CAST(strlen(x) AS INTEGER) AS length, 1.0::DOUBLE AS confidence, 'address' AS label FROM u""",
    }
