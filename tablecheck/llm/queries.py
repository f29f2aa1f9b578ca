"""One query per operator over its whole table, and its result in SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablecheck.llm import (
    bottom_k,
    clustering,
    exact_dedup,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    private_data,
    quality_classifier,
    quality_rules,
    repeated_bytes,
    resampling,
    toxicity,
)
from tablecheck.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


@query(
    "op1_line_dedup",
    f"""WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
      FROM documents),
    keyed AS (
      SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                          'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    repeated AS (
      SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
    marked AS (
      SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first AS gone
      FROM keyed k LEFT JOIN repeated r USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), ''))
        AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op1(spark, sf):
    return line_dedup.drop_repeated_lines(read_table(spark, sf, "documents"))


@query(
    "op2_quality_rules",
    r"""WITH docs AS (
      SELECT doc_id, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                    lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, i, words[i:i + 4] AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)),
    covered AS (
      SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
           (SELECT unnest(range(5)) AS k) WHERE n >= 2 GROUP BY doc_id),
    figures AS (
      SELECT d.doc_id, text, len(words) AS n_words,
        length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM docs d LEFT JOIN covered c USING (doc_id)),
    judged AS (
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 14 * n_words
        OR 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g'))
           > 50 * length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))
        OR 100 * length(regexp_replace(text, '[^!?]+', '', 'g')) > 30 * n_words) AS kept
    FROM judged""",
)
def op2(spark, sf):
    verdicts = quality_rules.quality_verdicts(read_table(spark, sf, "documents"))
    return verdicts.drop("rejected_by")


@query(
    "op9_exact_dedup",
    r"""WITH docs AS (
      SELECT doc_id, length(coalesce(text, '')) AS chars,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain
      FROM documents),
    placed AS (
      SELECT *, first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id)
        AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size FROM docs)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256
    FROM placed""",
)
def op9(spark, sf):
    return exact_dedup.groups(read_table(spark, sf, "documents"))


@query("op8_quality_classifier")
def op8(spark, sf):
    return quality_classifier.quality_scores(
        read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    )


@query("op10_toxicity")
def op10(spark, sf):
    return toxicity.toxicity_scores(
        read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    )


@query("op4_mixing")
def op4(spark, sf):
    return mixing.mixture(read_table(spark, sf, "documents"))


@query("op5_personal_data")
def op5(spark, sf):
    return private_data.personal_data(read_table(spark, sf, "documents")).drop("_terms")


@query("op7_packing")
def op7(spark, sf):
    return packing.packed(read_table(spark, sf, "documents"))


@query(
    "op6_jaccard_join",
    r"""WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
          WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
          END) AS s FROM words)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
      FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
      WHERE 100 * k >= 90 * (x.n + y.n - k)),
    reach AS (
      SELECT a AS doc_id, b AS other FROM links
      UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, min(other)) AS component_id
    FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r USING (doc_id)
    GROUP BY w.doc_id, n""",
)
def op6(spark, sf):
    return jaccard_join.near_equal(read_table(spark, sf, "documents")).drop("_id", "_tag")


# words of at most 16 MB; a word's buckets are found once, whatever the number of documents
CRC32 = """list_reduce(list_prepend(4294967295, list_transform(
      range(1, strlen({0}) + 1), lambda i: ('0x' || hex(encode({0}))[2 * i - 1:2 * i])::BIGINT)),
      lambda c, b: xor(c >> 8, table_[(xor(c, b) & 255) + 1]))"""


@query(
    "op11_importance_resampling",
    rf"""WITH step AS (
      SELECT list_transform(range(256), lambda n: list_reduce(
        list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1
          THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS table_),
    texts AS (
      SELECT 0 AS target, doc_id, coalesce(text, '') AS text FROM documents
      UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
    words AS (
      SELECT target, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
    held AS (SELECT target, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
    coded AS (
      SELECT word, xor({CRC32.format("word")}, 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT word FROM held), step),
    counts AS (
      SELECT bucket, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t
      FROM held JOIN coded USING (word) GROUP BY bucket),
    totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
    gains AS (
      SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
      FROM counts, totals),
    weights AS (
      SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight
      FROM held JOIN coded USING (word) JOIN gains USING (bucket) WHERE target = 0
      GROUP BY doc_id),
    scored AS (
      SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' ||
          sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM documents d LEFT JOIN weights w USING (doc_id)),
    placed AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
        count(*) OVER () AS able FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score,
      CASE WHEN place <= 10 * able // 100 THEN place END AS rank
    FROM scored LEFT JOIN placed USING (doc_id)""",
)
def op11(spark, sf):
    return resampling.resampled(
        read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    )


@query(
    "op12_bottom_k",
    SQL["op6_jaccard_join"]
    .replace(">= 90 *", ">= 85 *")
    .replace("SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, min(other)) AS component_id",
             "SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, min(other)) AS component_id,"
             " w.doc_id = least(w.doc_id, min(other)) AS kept"),
)
def op12(spark, sf):
    return bottom_k.near_duplicates(read_table(spark, sf, "documents")).drop("_id", "_tag")


def _clusters_sql(rounds: int = 5, clusters: int = 40) -> str:
    """One query per round: centroids of the vectors that are nearest to the centroids before."""

    def nearest(name: str, centroids: str) -> str:
        return f"""{name} AS MATERIALIZED (
          SELECT vec_id, v, min(struct_pack(d := d, c := c)).d AS distance,
            min(struct_pack(d := d, c := c)).c AS cluster
          FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m),
                  lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, {centroids})
          GROUP BY vec_id, v)"""

    steps = []
    for k in range(rounds):
        steps.append(nearest(f"near{k}", f"mid{k}"))
        steps.append(
            f"""mid{k + 1} AS MATERIALIZED (
          SELECT c, CASE WHEN s.cluster IS NULL THEN m ELSE s.means END AS m
          FROM mid{k} LEFT JOIN (
            SELECT cluster, list(mean ORDER BY i) AS means FROM (
              SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))
                // count(*))::BIGINT AS mean
              FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k})
              GROUP BY cluster, i) GROUP BY cluster) s ON s.cluster = c)"""
        )
    last = nearest("final", f"mid{rounds}")
    return f"""WITH kept AS MATERIALIZED (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
          FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        mid0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM kept
          ORDER BY sha256('2:' || vec_id) LIMIT {clusters}),
        {", ".join(steps)}, {last}
        SELECT vec_id, cluster::INTEGER AS cluster, distance,
          (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
          (sum(distance) OVER ())::BIGINT AS inertia,
          sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM final JOIN mid{rounds} ON c = cluster"""


@query("op13_clustering", _clusters_sql())
def op13(spark, sf):
    return clustering.clustered(read_table(spark, sf, "embeddings"))


@query("op3_repeated_bytes")
def op3(spark, sf):
    return repeated_bytes.without_repeats(read_table(spark, sf, "documents"))
