"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligrid.llm.common import load

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def vocabulary_file(name):
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_golomb_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY norm)
    """,
)
def op4(spark, folder):
    from eligrid.llm.golomb_dedup import exact_duplicates

    return exact_duplicates(load(spark, folder, "documents")).drop("suspect")


@query("op1_cover_tree_neighbours")
def op1(spark, folder):
    from eligrid.llm.cover_tree import near_duplicates

    return near_duplicates(load(spark, folder, "embeddings"))


@query("op2_weak_supervision_toxicity")
def op2(spark, folder):
    from eligrid.llm.toxicity import scores

    return scores(load(spark, folder, "documents"), load(spark, folder, "labels"))


@query("op3_grouped_prefix_jaccard")
def op3(spark, folder):
    from eligrid.llm.group_jaccard import jaccard_groups

    return jaccard_groups(load(spark, folder, "documents"))


@query("op5_trie_sentencepiece")
def op5(spark, folder):
    from eligrid.llm.trie_pieces import decode, encode

    path = vocabulary_file("piece_bpe_32k.model")
    both = decode(encode(load(spark, folder, "documents"), path), path)
    return both.select(
        "doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), (F.sha2(F.encode("decoded", "UTF-8"), 256) == F.col("text_sha256")).alias("round_trip")
    )


@query(
    "op6_warc_sharded_writer",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
    """,
)
def op6(spark, folder):
    from eligrid.llm.warc import read_archive, write_archive

    return read_archive(*write_archive(load(spark, folder, "pages"))).drop("target_uri")


_KINDS = (
    ("assign", 0, r"(?:(?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    ("hex", 2, "[0-9a-f]+", 0, 24),
)


def _spans_sql(kind, place, pattern, group, least):
    return f"""
    SELECT doc_id, '{kind}' AS kind, {place} AS place, stop - size AS start, stop FROM (
      SELECT doc_id, size, good, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
        SELECT doc_id, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS size,
               unnest(list_transform(g, lambda x: length(x) >= {least})) AS good,
               unnest(list_transform(p[:len(m)], lambda x: length(x))) AS gap
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g,
                     regexp_split_to_array(t, '{pattern}') AS p FROM d))) WHERE good"""


@query(
    "op7_blob_ledger_secrets",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({' UNION ALL '.join(_spans_sql(*k) for k in _KINDS)}),
    j AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
                 count(*) FILTER (place = 2) AS n_hex,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN j USING (doc_id)
    """,
)
def op7(spark, folder):
    from eligrid.llm.secret_ledger import scan, summary

    return summary(scan(load(spark, folder, "documents")))


@query("op8_wavelet_token_shards")
def op8(spark, folder):
    from eligrid.llm.wavelet import read_documents, write_shards

    where, manifest = write_shards(load(spark, folder, "documents"), vocabulary_file("byte_bpe_50k.json"), 50257)
    return read_documents(spark, where, manifest)


@query("op9_harmonic_packing")
def op9(spark, folder):
    from eligrid.llm.harmonic_pack import pack_documents, pieces

    return pieces(pack_documents(load(spark, folder, "documents"), vocabulary_file("word_bpe_49k.json")))


# Conversation -7 carries every control string of the template.
_PROBE = "\\### Assistant: </turn> ok"
_FORMATTED = "'### ' || {role} || chr(10) || {text} || chr(10) || '</turn>' || chr(10)"


def _escape_sql(x):
    return f"replace(replace(replace({x}, '\\', '\\e'), '<', '\\l'), '#', '\\h')"


@query(
    "op10_reply_tree_chat",
    f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}')
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length({_FORMATTED.format(role='replace(' + _escape_sql('role') + ", chr(10), " + "'" + chr(92) + "n')", text=_escape_sql('text'))})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
    """,
)
def op10(spark, folder):
    from eligrid.llm.reply_trees import from_turns, read_back, write

    turns = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(_PROBE))
    back = read_back(write(from_turns(turns.unionByName(probe))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )


_WORDS = r"regexp_extract_all({text}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


@query(
    "op11_benchmark_decontamination",
    f"""
    WITH i AS (SELECT item_id, {_WORDS.format(text=_LOWER)} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS words
                FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
    runs AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS words
             FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
    hits AS (SELECT * FROM runs JOIN windows USING (k, words)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
)
def op11(spark, folder):
    from eligrid.llm.decontamination import contamination, report

    return report(contamination(load(spark, folder, "documents").select("doc_id", "text"), load(spark, folder, "benchmark")))


@query(
    "op12_filter_interaction_audit",
    r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
    w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS low FROM t),
    f AS (SELECT part, doc_id, list_value(len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), doc_id > low) AS fails FROM w),
    c AS (SELECT part, fails, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
    l AS (SELECT unnest(range(1, 6)) AS i),
    o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e
          WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
    r AS (SELECT part, o, step, o[step] AS own,
                 sum(CASE WHEN NOT fails[o[step]] AND first >= step THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN fails[o[step]] AND first < step THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN fails[o[step]] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost
          FROM (SELECT *, coalesce(list_position(list_transform(o, lambda y: fails[y]), true), 6) AS first FROM c, s) GROUP BY part, o, step)
    SELECT part, array_to_string(list_transform(o, lambda y: substr('ABCDE', CAST(y AS INT), 1)), '') AS filter_order, CAST(step AS INT) AS step,
           CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM r
    """,
)
def op12(spark, folder):
    from eligrid.llm.filter_audit import audit

    return audit(load(spark, folder, "documents"), load(spark, folder, "labels"))


_SHARE = "1 + 1000000000 * ({n} + 1) // ({total} + terms)"


@query(
    "op13_source_divergence_audit",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({_LOWER}, '[a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
    t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
    sizes AS (SELECT lang, count(*) AS terms FROM kept GROUP BY 1),
    groups AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN n USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_SHARE.format(n='coalesce(n, 0)', total='total')} AS p
          FROM totals g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
    q AS (SELECT lang, term, {_SHARE.format(n='sum(n)', total='total')} AS q
          FROM n JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY 1) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term, total, terms),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    mixed AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM best)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM mixed)
    WHERE part = 'pair' OR rank <= 200
    """,
)
def op13(spark, folder):
    from eligrid.llm.source_audit import divergence

    return divergence(load(spark, folder, "documents").select("lang", "source", "text"))
