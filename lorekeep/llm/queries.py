"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.class_ngrams import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.quality_rules import fit_quality_model, score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit_quality_model(docs, read_table(spark, sf_dir, "labels")))


#: Shards of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.sharding import place

    return place(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def _op3_oracle() -> str:
    """The keys' hashes and the look-up; the table itself is tested against a plain filling."""
    from lorekeep.llm.sharding import fill_table, next_prime

    slots = next_prime(100 * len(SHARDS))
    table = ",".join(map(str, fill_table(SHARDS, slots)))
    return f"""
        SELECT doc_id, slot, CAST(([{table}])[slot + 1] AS INTEGER) AS shard
        FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT % {slots} AS slot FROM documents)"""


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.token_output import write_and_read

    return write_and_read(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.importance_sampling import resample
    from lorekeep.llm.quality_rules import good_labels

    labels = good_labels(read_table(spark, sf_dir, "labels"))
    share = labels.agg(F.avg("good")).first()[0]  # as many as are good, judged by the labels
    return resample(read_table(spark, sf_dir, "documents"), labels.where("good = 1"), 1.0 if share is None else share)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.piece_codec import digest

    return digest(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.license_scan import scan

    return scan(read_table(spark, sf_dir, "documents"))


def _op7_oracle() -> str:
    """Every window of words against every template."""
    from lorekeep.llm.license_scan import LEAST, PHRASES, TEMPLATES, window_words

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({quoted(sorted(set(t.split())))}, {len(set(t.split()))}, {window_words(t)}, '{label}')" for t, label in TEMPLATES)
    return f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
        place AS (SELECT doc_id, p, label FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d), (VALUES {phrases}) v(ph, n, label) WHERE w[p + 1:p + n] = ph),
        base AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS b FROM place GROUP BY doc_id),
        possible AS (SELECT doc_id, w, ws, n, wide, label FROM d, (VALUES {templates}) v(ws, n, wide, label) WHERE {LEAST.denominator} * len(list_intersect(list_distinct(w), ws)) >= {LEAST.numerator} * n),
        block AS (SELECT doc_id, label, ws, n, list_distinct(w[p:p + wide - 1]) AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM possible)),
        met AS (SELECT doc_id, label, len(list_intersect(s, ws)) / n AS share FROM block WHERE {LEAST.denominator} * len(list_intersect(s, ws)) >= {LEAST.numerator} * n),
        best AS (SELECT doc_id, max(share) AS score FROM met GROUP BY doc_id),
        bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT doc_id, label FROM place) GROUP BY doc_id),
        al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM met) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.b AS BIGINT) AS last_word,
               coalesce(bl.l, '') AS base_labels, coalesce(al.l, '') AS labels, CAST(coalesce(best.score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN best USING (doc_id)"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.decontamination import find_leaks

    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.jaccard_join import similar_documents

    return similar_documents(read_table(spark, sf_dir, "documents"), n=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def _links_oracle(percent: int, columns: str) -> str:
    """All pairs that share a shingle; components by recursion."""
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (
                SELECT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w WHERE len(w) > 0))),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
                 JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {percent} * (na.n + nb.n - i)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, {columns}
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.suffix_dedup import digest, remove_repeats

    return digest(remove_repeats(read_table(spark, sf_dir, "documents"), length=50))


def op11_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.sketch_join import near_copies

    return near_copies(read_table(spark, sf_dir, "documents"), n=3, num=85, den=100)


def op12_pivot_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.pivot_clustering import cluster_vectors

    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def _op12_oracle(dims: int = 64, clusters: int = 8, rounds: int = 10) -> str:
    """Each round as a step of its own, every vector against every centroid."""
    steps = [f"""
        v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
              WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS INTEGER) AS k, q AS c FROM v QUALIFY k < {clusters})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (SELECT r, vec_id, q, k, d FROM (SELECT r, vec_id, q, k, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i})
              QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (SELECT k, list(m ORDER BY p) AS c FROM (
              SELECT k, p, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT k, unnest(q) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY k, p) GROUP BY k),
        c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (k)"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.filter_audit import audit

    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_class_ngrams": op1_class_ngrams,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_token_output": op4_token_output,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_piece_codec": op6_piece_codec,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_sketch_join": op11_sketch_join,
    "op12_pivot_clustering": op12_pivot_clustering,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op3_sharding": _op3_oracle(),
    "op7_license_scan": _op7_oracle(),
    "op12_pivot_clustering": _op12_oracle(),
    "op13_filter_audit": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        cell AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
        o AS (SELECT '' AS o UNION ALL SELECT o || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE NOT contains(o, c)),
        step AS (SELECT o AS filter_order, s AS step, ascii(o[s]) - 64 AS own, list_transform(string_split(o[1:s - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) - 64 END) AS before FROM (SELECT o, unnest(range(1, 6)) AS s FROM o WHERE length(o) = 5)),
        met AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k FROM cell, step),
        sums AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant,
                        sum(CASE WHEN fail AND k = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY part, filter_order, step)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM sums""",
    "op9_jaccard_join": _links_oracle(90, "r.c AS component_id"),
    "op11_sketch_join": _links_oracle(85, "r.c AS component_id, d.doc_id = r.c AS kept"),
    "op10_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
              FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
        least AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s),
        hit AS (SELECT w.doc_id, w.p FROM w JOIN least USING (s) WHERE least.first_doc < w.doc_id),
        step AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
        run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM step),
        span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, r),
        edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
        kept AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * e.before + 1, 2 * (e.a - e.before)), '' ORDER BY e.a) AS k, max(e.b) AS last, sum(e.b - e.a) AS removed, count(*) AS n
                 FROM edge e JOIN d USING (doc_id) GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(k.k, '') || substr(d.h, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept k USING (doc_id)""",
}
