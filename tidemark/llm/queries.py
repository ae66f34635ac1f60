"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, join, language, lines, manifest, merkle, mix, pack, phrases, shared, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of labelled documents: 2 for good ones, 0.5 for poor ones."""
    return _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir)).drop("text_hash")


#: The tools that the conversations' turns stand for: a user's turn asks for a reply, a system's turn sets instructions.
SCHEMAS = {"reply": {"prompt": "string", "chars": "integer", "language": "string?"}, "configure": {"instructions": "string"}}


def tool_calls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of every row of conversations; a hash of conversation and turn deals out the faults.

    An assistant's turn is the result of the turn before; of 16, one is the result of the turn after, and one of a call that
    there isn't. Any other turn, whatever its role, is a call: of 4, two need the call two turns before, one that two turns
    after, and one none; of 16, one each has a number as text, no prompt, one more argument, or no JSON.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    deal = F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary"))
    rows = rows.withColumn("fault", F.pmod(deal, F.lit(16))).withColumn("need", F.pmod(F.floor(deal / 16), F.lit(4)))
    name = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    text, chars, fault = F.col("text"), F.length("text"), F.col("fault")
    # A null text gives a null prompt, which JSON leaves out.
    prompt = F.when(fault == 0, F.to_json(F.struct(text.alias("prompt"), chars.cast("string").alias("chars"))))
    prompt = prompt.when(fault == 1, F.to_json(F.struct(chars.alias("chars")))).when(fault == 2, F.to_json(F.struct(text.alias("prompt"), chars.alias("chars"), F.col("turn"))))
    prompt = prompt.when(fault == 3, text).otherwise(F.to_json(F.struct(text.alias("prompt"), chars.alias("chars"))))
    rules = F.to_json(F.struct(text.alias("instructions")))
    tool = F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "configure").otherwise(F.col("role"))
    after = F.when(F.col("need") <= 1, F.array(name(2))).when(F.col("need") == 2, F.array(name(-2)))
    says = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = rows.where(~says).select("conv_id", name(0).alias("call_id"), "turn", tool.alias("name"), F.when(F.col("role") == "system", rules).otherwise(prompt).alias("arguments"), after.alias("after"))
    of = F.when(fault == 0, name(-1)).when(fault == 1, F.concat(F.lit("x"), name(0))).otherwise(name(1))
    return calls, rows.where(says).select("conv_id", of.alias("call_id"), "turn", F.col("text").alias("content"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, orders and validates what tool_calls makes of all conversations."""
    return chat.link_tools(*tool_calls(_table(spark, sf_dir, "conversations")), SCHEMAS)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages' archive in the shared folder, reads it back and reports what the headers and payloads say."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", F.encode("html", "UTF-8").alias("payload"))
    path = f"{shared.folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(pages, path)
    found = warc.read_archive(spark, path)
    field = lambda name: warc.field(F.col("header"), name)
    return found.select(
        F.expr("try_cast(regexp_extract(cast(header as string), 'WARC-Record-ID: <urn:page:(-?[0-9]+)>', 1) as bigint)").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1")).otherwise(F.raise_error(F.lit("header and payload differ"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.expr("try_cast(regexp_extract(cast(header as string), 'WARC-Refers-To: <urn:page:(-?[0-9]+)>', 1) as bigint)").alias("refers_to"),
    )


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(remainder("doc_id", 3) != 1))
    return language.predict(docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(remainder("doc_id", 5) != 0), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: what its text has become."""
    docs = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "lines", "dropped_lines", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf shows its own digest, or, where 7 divides the crc32 of doc_id, that of a row with n_chars one larger."""
    fields = [F.col(x).cast("long") if x == "doc_id" else F.col(x) for x in manifest.FIELDS]
    tampered = manifest.leaf_digest(*[x + 1 if name == "n_chars" else x for name, x in zip(manifest.FIELDS, fields, strict=True)])
    made = manifest.build(_table(spark, sf_dir, "documents"), shown=F.when(remainder("doc_id", 7) == 0, tampered))
    return manifest.verify(made).drop("proof")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25_packing": op1_bm25_packing,
    "op2_mix_sources": op2_mix_sources,
    "op3_tool_calls": op3_tool_calls,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc_archive": op5_warc_archive,
    "op6_merkle": op6_merkle,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op5_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (
            SELECT page_id, h, strlen(h) AS payload_bytes,
                   array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     1 + CAST((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest
            FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
        FROM d WINDOW w AS (PARTITION BY h)
    """,
    "op11_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists CROSS JOIN range(1, 6) t(k) WHERE len(w) >= k),
        f AS (SELECT lang, k, w[i : i + k - 1] AS p, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100),
        totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
        cuts AS (SELECT x.lang, x.k, x.p, x.a, y.a AS l, z.a AS r, t.n, j, CAST(1000 AS HUGEINT) * x.a * t.n // (CAST(y.a AS HUGEINT) * z.a) AS score
                 FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) x JOIN f y ON y.lang = x.lang AND y.p = x.p[1 : j] JOIN f z ON z.lang = x.lang AND z.p = x.p[j + 1 : x.k] JOIN totals t ON t.lang = x.lang),
        least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
        wider AS (SELECT lang, a, unnest([p[1 : k - 1], p[2 : k]]) AS p FROM f WHERE k > 2),
        kept AS (SELECT *, array_to_string(p, ' ') AS phrase FROM least x WHERE NOT EXISTS (SELECT 1 FROM wider y WHERE y.lang = x.lang AND y.p = x.p AND y.a >= x.a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM documents),
        leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                          sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other FROM f),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
        up AS (
            SELECT lang, 0 AS h, list(leaf ORDER BY i) AS nodes FROM placed GROUP BY lang
            UNION ALL
            SELECT lang, h + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM up WHERE len(nodes) > 1),
        subroots AS (SELECT lang, nodes[1] AS subroot, h AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM up WHERE len(nodes) = 1),
        top AS (
            SELECT 0 AS h, list(subroot ORDER BY t) AS nodes FROM subroots
            UNION ALL
            SELECT h + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM top WHERE len(nodes) > 1),
        whole AS (SELECT nodes[1] AS root, h AS height FROM top WHERE len(nodes) = 1),
        steps AS (
            SELECT p.lang, p.i, u.h AS step, (p.i >> u.h) & 1 AS odd, u.nodes[xor(p.i >> u.h, 1) + 1] AS sibling
            FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.h < s.height
            UNION ALL
            SELECT p.lang, p.i, s.height + u.h, (s.t >> u.h) & 1, u.nodes[xor(s.t >> u.h, 1) + 1]
            FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN whole w JOIN top u ON u.h < w.height),
        listed AS (SELECT lang, i, list({'odd': odd, 'sibling': sibling} ORDER BY step) AS path, string_agg(coalesce(sibling, ''), '' ORDER BY step) AS siblings FROM steps GROUP BY lang, i),
        crcs AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                   lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
                 FROM (SELECT DISTINCT doc_id FROM documents)),
        shown AS (SELECT p.doc_id, p.lang, p.leaf, coalesce(l.siblings, '') AS siblings, coalesce(l.path, []) AS path, CASE WHEN c.crc % 7 = 0 THEN p.other ELSE p.leaf END AS shown
                  FROM placed p LEFT JOIN listed l ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i JOIN crcs c ON c.doc_id IS NOT DISTINCT FROM p.doc_id),
        folds AS (SELECT *, list_reduce(list_concat([{'odd': CAST(0 AS BIGINT), 'sibling': shown}], path), lambda y, s: {'odd': CAST(0 AS BIGINT), 'sibling':
                    sha256(CASE WHEN s.sibling IS NULL THEN y.sibling WHEN s.odd = 1 THEN s.sibling || y.sibling ELSE y.sibling || s.sibling END)}).sibling AS folded_root FROM shown)
        SELECT f.doc_id, f.leaf, s.subroot, w.root, sha256(f.siblings) AS proof_sha256, f.folded_root, f.folded_root = w.root AS verified
        FROM folds f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang CROSS JOIN whole w
    """,
    "op13_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT row, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
        e AS (SELECT row, unnest(g) AS x FROM s),
        p AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.row < b.row GROUP BY ALL),
        links AS (SELECT p.a, p.b FROM p JOIN s x ON x.row = p.a JOIN s y ON y.row = p.b WHERE 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT row, row AS r FROM s UNION SELECT reach.row, ways.b FROM reach JOIN ways ON ways.a = reach.r)
        SELECT s.doc_id, CAST(len(any_value(s.g)) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id FROM s JOIN reach ON reach.row = s.row JOIN s t ON t.row = reach.r GROUP BY s.row, s.doc_id
    """,
}
