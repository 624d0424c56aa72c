"""The queries of this subpackage over the driver's tables, and their SQL where it can express one.

Near-duplicates are defined by exact sets, decontamination by masks over tokens, the audit by counts
and vector codes by whole numbers: these have SQL. The others learn models, tokenize, hash as DuckDB
cannot (XXH64 with a seed), search by an approximate index, or (secrets) use patterns with
look-around, which DuckDB lacks; they are tested against brute force, exact round trips and held-out
accuracy instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bbit_minhash import near_duplicates
from .common import spread, table
from .credential_linking import secrets_query
from .filter_audit import AUDIT_SQL, audit
from .filtering_lloyd import codes_sql, compressed
from .gam_quality import quality_query
from .mil_toxicity import toxicity_query
from .pigeonring import near_fingerprints
from .pow2_packing import packing_query
from .ppm_langid import language_query
from .prefix_forest import neighbours_query
from .spaced_seed import overlaps
from .trie_counts import count_tokens
from .weak_pii import pii_query


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: spread(table(s, d, "documents"))
    return {
        "op1_quality": lambda s, d: quality_query(docs(s, d), table(s, d, "labels")),
        "op2_language": lambda s, d: language_query(docs(s, d)),
        "op3_packing": lambda s, d: packing_query(docs(s, d), tokenizer_path("word_bpe_49k.json")),
        "op4_secrets": lambda s, d: secrets_query(docs(s, d)),
        "op5_toxicity": lambda s, d: toxicity_query(docs(s, d), table(s, d, "labels")),
        "op6_near_duplicates": lambda s, d: near_duplicates(docs(s, d)),
        "op7_neighbours": lambda s, d: neighbours_query(table(s, d, "embeddings")),
        "op8_decontamination": lambda s, d: overlaps(docs(s, d), table(s, d, "benchmark")),
        "op9_token_counts": lambda s, d: count_tokens(docs(s, d), tokenizer_path("piece_bpe_32k.model")),
        "op10_personal_data": lambda s, d: pii_query(docs(s, d)),
        "op11_filter_audit": lambda s, d: audit(docs(s, d), table(s, d, "labels")),
        "op12_fingerprints": lambda s, d: near_fingerprints(docs(s, d)),
        "op13_vector_codes": lambda s, d: compressed(table(s, d, "embeddings")),
    }


#: Exact sets and links of whole texts, then the smallest id that links reach.
NEAR_DUPLICATES = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, hash(s_) AS h FROM (SELECT doc_id, s, unnest(s) AS s_ FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = s.doc_id AS kept FROM s JOIN c USING (doc_id)"""


def decontamination_sql() -> str:
    """Masked tokens at every position of both tables, joined; surroundings compared token by token."""
    from .spaced_seed import AROUND, EQUAL, LIGHT, MASKS, PART, SHARE, SHORTEST, SPAN, WHOLE

    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r!-/:-@\[-`{-~]+'), lambda x: x <> '')"
    seeds = lambda m: "array_to_string([" + ", ".join(f"t[i + {k + 1}]" for k, bit in enumerate(m) if bit == "1") + "], ' ')"
    masks = [(f, m, f"len(t) >= {SHORTEST}" + (f" AND len(t) < {WHOLE}" if f >= len(MASKS) else "")) for f, m in enumerate((*MASKS, *LIGHT))]
    at = lambda table, key, m, f, also: f"SELECT {key}, t, i, {f} AS f, {seeds(m)} AS s FROM (SELECT {key}, t, unnest(range(0, len(t) - {len(m) - 1})) AS i FROM {table} WHERE len(t) >= {len(m)} AND {also})"
    docs = " UNION ALL ".join(at("d", "doc_id", m, f, "true") for f, m, _ in masks)
    items = " UNION ALL ".join(at("b", "item_id", m, f, also) for f, m, also in masks)
    reach = lambda n: f"CASE WHEN len(b.t) < {WHOLE} THEN {WHOLE} ELSE {n} END"
    return f"""WITH d AS (SELECT doc_id, {words} AS t FROM documents), b AS (SELECT item_id, {words} AS t FROM benchmark), ds AS ({docs}), bs AS ({items}),
m AS (SELECT DISTINCT doc_id, item_id, d.t AS h, b.t AS o, d.i AS i, b.i AS j, least(d.i, b.i, {reach(AROUND)}) AS back, least(len(d.t) - d.i, len(b.t) - b.i, {reach(SPAN + AROUND)}) AS ahead FROM ds d JOIN bs b ON d.f = b.f AND d.s = b.s),
c AS (SELECT doc_id, item_id, len(o) AS n, len(list_filter(range(0, back + ahead), lambda x: h[i - back + x + 1] = o[j - back + x + 1])) AS equal, back + ahead AS compared, i - back AS doc_at, j - back AS item_at FROM m),
a AS (SELECT doc_id, item_id, equal, compared, doc_at, item_at FROM c WHERE equal >= least({EQUAL}, ceil({PART} * n)) AND equal >= {SHARE} * compared
UNION ALL SELECT doc_id, item_id, len(d.t), len(d.t), 0, 0 FROM d JOIN b ON d.t = b.t WHERE len(d.t) BETWEEN 1 AND {SHORTEST - 1}),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, compared, doc_at, item_at) AS k FROM a)
SELECT doc_id, item_id, equal::INT AS equal, compared::INT AS compared, doc_at::INT AS doc_at, item_at::INT AS item_at FROM k WHERE k = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_duplicates": NEAR_DUPLICATES, "op8_decontamination": decontamination_sql(), "op11_filter_audit": AUDIT_SQL, "op13_vector_codes": codes_sql()}
