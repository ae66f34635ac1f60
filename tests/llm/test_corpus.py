from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language, merkle, mix, pack, queries, simhash, toxicity, warc

SF = "/root/testdata/sf0.001"


def test_pack_round_trip(docs, empty, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    want = Counter((r[0], *library.encode(r[1] or "", add_special_tokens=False).ids, 2) for r in texts)
    for shard_words in (2000, 10**6):
        pieces = pack.pack(docs, path, window=256, with_ids=True, shard_words=shard_words).collect()
        by_sequence = defaultdict(list)
        for p in pieces:
            by_sequence[p.sequence_id].append(p)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) and p.length == len(p.ids)
        full = 0
        for own in by_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            full += at == 256
            assert at <= 256
        assert full >= len(by_sequence) - len({s >> 32 for s in by_sequence})
        # Pieces of a document put together again: it goes on at the next window's begin.
        got, parts = Counter(), []
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            if p.start == 0:
                parts.append((p.doc_id, []))
            assert parts[-1][0] == p.doc_id and len(parts[-1][1]) == p.start
            parts[-1][1].extend(p.ids)
        for i, ids in parts:
            got[i, *ids] += 1
        assert got == want
    assert pack.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["I'm don't it's 's.", "a,b a,, ,a 'a', x. .x 1.5 1, é. É, ÉÀ.", "<|endoftext|> x<|endoftext|>.y", "x <|EndOfText|> y <|startoftext|>", " a　b. c, 日本語。 日本語. ΑΣ ΣΑΣ. İstanbul, ́ a ́b ŉ ǆ ǅ ſ ß ª º µ", "abc%%% d'ef!! x|> l'à... a's. b'. c.' “q” e—f… <|endoftext|>", "#$%... ... ., ,. z.. \x1c a\x1db \x85 x", "", " ", "a" * 500 + " b" * 5000])
def test_tokens_are_the_library_s(text):
    import pyarrow as pa

    mine = pack.Tokens(queries.tokenizer_path())
    texts = pa.array(["before", text, None, text + "z", "After it"])
    have = pack.words(texts)
    got = pack.document_ids(texts, have, *pack.distinct(have), mine, 2)
    assert [x.tolist() for x in got] == [[*mine.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts.to_pylist()]


def brute_bm25(bags: list, seed: int, unused: list) -> list:
    n, mean = len(bags), sum(sum(x.values()) for x in bags) / len(bags)
    score = {}
    for d, bag in enumerate(bags):
        s = 0.0
        for t in bags[seed].keys() & bag.keys():
            df = sum(t in x for x in bags)
            s += np.log1p((n - df + 0.5) / (df + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
        if unused[d] and s:
            score[d] = s
    return sorted(score, key=lambda d: (-round(score[d], 4), d))


def test_packing_matches_brute_force():
    """All neighbours of every seed, more than are sorted at once, and whole windows, against plain BM25 over all terms."""
    import random

    import pyarrow as pa

    rng = random.Random(8)
    raw = [" ".join(f"w{min(int(rng.expovariate(0.03)), 400)}" for _ in range(rng.randint(1, 30))) for _ in range(150)] + ["", None]
    bags = [Counter((x or "").split()) for x in raw]
    have = pack.words(pa.array(raw))
    df = np.bincount(np.unique(have.row.astype(np.int64) * pack.TERMS + have.term) % pack.TERMS, minlength=pack.TERMS)
    assert (df > 0).sum() == len(set().union(*bags))  # no two words share a term here
    idf = np.log1p((len(raw) - df + 0.5) / (df + 0.5)).astype(np.float32)
    index = pack.Index(have.row, have.term, len(raw), idf, len(have.start) / len(raw))
    unused = np.array([k % 7 != 0 for k in range(len(raw))])
    for seed in range(len(raw)):
        got = list(index.neighbours(seed, unused))
        want = brute_bm25(bags, seed, unused)
        assert set(got) == set(want) and sum(a != b for a, b in zip(got, want, strict=True)) <= 2  # rounding may swap near ties
    sizes, left, order = np.array([len((x or "").split()) + 1 for x in raw]), [True] * len(raw), []
    offset, queue = 0, []
    while any(left):
        doc, seeds = (queue.pop(0), offset == 0) if queue else (left.index(True), True)
        left[doc] = False
        order.append(doc)
        cut = (offset + sizes[doc]) // 64 > 0
        offset = (offset + sizes[doc]) % 64
        queue = [] if not offset else brute_bm25(bags, doc, left) if seeds or cut else [d for d in queue if left[d]]
    got = [p[0] for p in pack.fill(sizes, index, 64) if p[1] == 0]
    assert sorted(got) == list(range(len(raw))) and sum(a == b for a, b in zip(got, order, strict=True)) >= 0.9 * len(raw)


def test_related_documents_share_a_shard(spark):
    """Groups that share half of their words are dealt together far more often than by chance, at many shards."""
    import random

    rng = random.Random(1)
    rows = []
    for g in range(60):
        base = [f"g{g}x{k}" for k in range(40)]
        rows += [(10 * g + k, " ".join(rng.sample(base, 30) + [f"u{g}y{k}z{j}" for j in range(10)] + ["the of and"] * 3)) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frequency, n, _ = pack.document_frequencies(df)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    shard = {r.doc_id: r.shard for r in pack.deal(df, frequency, idf, 600).collect()}
    assert len(set(shard.values())) >= 30
    together = sum(shard[10 * g + a] == shard[10 * g + b] for g in range(60) for a in range(10) for b in range(a))
    assert together >= 0.4 * 60 * 45  # one in fifty by chance


LARGE = (1 << 53) + 1


def test_ids_beyond_doubles_stay_exact_beside_nulls(spark):
    rows = [(LARGE, "one two three four five six", "en", "s"), (None, "one two three four five", "en", "s"), (LARGE + 2, "one two three four five six", "fr", "t"), (-LARGE, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    want = {r[0] for r in rows}
    assert {r.doc_id for r in pack.pack(df, queries.tokenizer_path()).collect()} == want
    assert {r.doc_id for r in merkle.fingerprints(df).collect()} == want
    model = language.train(df)
    assert {r.doc_id for r in language.predict(df, model).collect()} == want
    assert {r.doc_id for r in language.label_spans(df, model).collect()} == want - {-LARGE}
    assert {r.doc_id for r in toxicity.score(df, toxicity.train(df, df.select("doc_id", F.lit(1).alias("toxic")))).collect()} == want
    near = simhash.near_duplicates(df)
    assert {(r.doc_id, r.component_id) for r in near.collect()} == {(LARGE, LARGE), (LARGE + 2, LARGE), (None, None), (-LARGE, -LARGE)}


def test_held_out_follows_the_id(spark, tmp_path):
    rows = [(LARGE + 2 * k, f"word{k} the and of {k}", "en", "s", 10) for k in range(40)] + [(None, "x y", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, k % 2) for k, r in enumerate(rows[:-1])], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, by, rest in (("op7_language", 3, 1), ("op8_toxicity", 5, 0)):
        got = {r.doc_id: r.held_out for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % by == rest for r in rows}


def water(sizes: dict, share: float) -> dict:
    """Targets by sharing again and again what is over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        got = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in got.items():
            target[s] += x
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix(docs, empty, texts):
    import re

    sizes, largest = defaultdict(int), defaultdict(int)
    for r in texts:
        largest[r[3]] = max(largest[r[3]], len((r[1] or "").split()))
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = water(dict(sizes), 1.5)
    rows = mix.mix(docs).collect()
    assert rows == mix.mix(docs.repartition(3)).collect() or sorted(rows, key=repr) == sorted(mix.mix(docs.repartition(3)).collect(), key=repr)
    assert len(rows) == len(texts) and all(r.taken <= 2 * r["size"] for r in rows)
    joined = mix.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect()
    for r in joined:
        assert abs(r.t - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert abs(r.n - r.t) <= largest[r.source] / 2  # whole documents, of which one may be most of its source
    assert mix.mix(empty).count() == 0
    assert mix.mixed_documents(docs).columns == docs.columns


def test_mix_follows_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("w w w w").alias("text"))
    good = docs.select("doc_id", F.when(F.col("doc_id") < 2000, 4.0).otherwise(1.0).alias("weight"))
    rows = mix.mix(docs, good, share=0.3).collect()
    taken = [sum(r.taken > 0 for r in rows if (r.doc_id < 2000) == k) for k in (True, False)]
    assert abs(sum(taken) - 1200) <= 1 and taken[0] > 2.2 * taken[1]


def test_chat(spark):
    calls = [(1, "a", 0, "reply", '{"prompt":"x","chars":1}', None), (1, "b", 2, "reply", '{"chars":"no","more":1}', ["c"]), (1, "c", 4, "reply", "not json", ["a"]), (1, "c", 4, "reply", "not json", ["a"]), (1, "d", 6, "nothing", "{}", ["e"]), (1, "e", 7, "configure", '{"instructions":"é\\n"}', ["d"]), (2, "a", 0, None, None, [None]), (None, "z", 0, "reply", "{}", None)]
    results = [(1, "a", 1, "fine"), (1, "b", 1, None), (1, "zz", 5, "lost"), (1, "a", 9, "late copy")]
    out = chat.link_tools(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), queries.SCHEMAS, rounds=3)
    got = {(r.conv_id, r.call_id): r for r in out.collect()}
    assert len(got) == 8 and got[None, "z"].status == "no_identifier" and got[None, "z"].errors == "missing:chars,missing:prompt"
    assert got[1, "a"].status == "linked" and got[1, "a"].errors == "" and got[1, "a"].repeats == 1
    assert got[1, "a"].message == '{"arguments":{"chars":1,"prompt":"x"},"content":"fine","id":"a","name":"reply"}'
    assert got[1, "b"].status == "early_result" and got[1, "b"].errors == "extra:more,missing:prompt,type:chars"
    assert (got[1, "b"].place, got[1, "b"].hops) == (4, 1) and got[1, "c"].errors == "not_an_object"
    assert got[1, "zz"].status == "orphan_result" and got[2, "a"].errors == "unknown_tool"
    assert got[1, "d"].hops is None and got[1, "d"].errors == "unknown_tool"
    assert json.loads(got[1, "e"].message)["arguments"] == {"instructions": "é\n"}
    assert all(json.loads(r.message)["id"] == k[1] for k, r in got.items())


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", b"same"), (2, "http://b\r\nX: y", b"same"), (3, None, None), (4, "http://c", b""), (5, "http://d", bytes(range(256))), (5, "http://d", bytes(range(256))), (None, "http://e", b"alone")]
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in rows], "record_id long, url string, payload binary")
    warc.write_archive(df, str(tmp_path / "w"))
    back = warc.read_archive(spark, str(tmp_path / "w"))
    assert Counter(bytes(r.payload) for r in back.collect()) == Counter(c or b"" for _, _, c in rows)
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 4
    kinds = Counter(r.k for r in back.select(warc.field(F.col("header"), "WARC-Type").alias("k")).collect())
    assert kinds == {"response": 5, "revisit": 2}
    for r in warc.original_records(back).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
        assert len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
    warc.write_warc(back, str(tmp_path / "files"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == len(rows) and bytes(range(256)) in data
    spark.read.parquet(str(tmp_path / "w" / "payloads")).withColumn("payload", F.lit(b"damaged")).write.parquet(str(tmp_path / "x" / "payloads"))
    spark.read.parquet(str(tmp_path / "w" / "records")).write.parquet(str(tmp_path / "x" / "records"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "x")).collect()
    assert warc.records(df.limit(0)).count() == 0


def test_merkle(docs, empty, texts):
    rows = merkle.fingerprints(docs).collect()
    assert len(rows) == len(texts)
    plain = sorted([r for r in texts if r[0] is not None and Counter(t[0] for t in texts)[r[0]] == 1], key=lambda r: r[0])
    by_id = {r.doc_id: r for r in rows}
    order = sorted({r[0] for r in texts if r[0] is not None})
    of = {r[0]: r[1] or "" for r in texts}
    for a in plain[:-1]:
        t, nxt = a[1] or "", of[order[order.index(a[0]) + 1]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = by_id[a[0]]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and (r.fingerprint == r.edited_fingerprint) == (t == edited)
    prints = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            prints[of[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({f for x in prints.values() for f in x}) == len(prints)
    assert merkle.fingerprints(empty).count() == 0
    a, b = merkle.tree("one\ntwo\nthree\n"), merkle.tree("one\n2\nthree\n")
    assert merkle.differences(a, b) == [1] and merkle.likeness(a, a) == 1.0 and 0 < merkle.likeness(a, b) < 1
    # The fingerprints alone give likeness and differences.
    for x in (a, b, merkle.tree("")):
        assert merkle.Tree.read(x.fingerprint) == x
    after = {r.doc_id: by_id[n] for r, n in ((by_id[x[0]], order[order.index(x[0]) + 1]) for x in plain[:-1])}
    for r in (by_id[x[0]] for x in plain[:-1]):
        t, e, nxt = (merkle.Tree.read(x) for x in (r.fingerprint, r.edited_fingerprint, after[r.doc_id].fingerprint))
        assert r.near_edited == merkle.likeness(t, e) and r.near_next == merkle.likeness(t, nxt)
        assert r.edited_paragraphs == len(merkle.differences(t, e))


def test_merkle_tree_by_hand():
    """Every byte in one leaf, leaves in order, hashed level by level; reordered leaves are another text."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = "".join(rng.choice(list("ab é\n"), 400))
        t = merkle.tree(text)
        lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
        assert sum(map(len, t.sections)) == len(lines)
        leaves = 0
        for line in lines:
            words = line.encode().split(b" ")
            leaves += 1 + sum(zlib.crc32(w) % merkle.LEAF_WORDS == 0 for w in words[:-1])
            leaves -= line.endswith(" ") and zlib.crc32(words[-2]) % merkle.LEAF_WORDS == 0
        assert t.leaves.total() == leaves
    x, y = merkle.tree("one\ntwo\n"), merkle.tree("two\none\n")
    assert x.root != y.root and 0.5 < merkle.likeness(x, y) < 1


def test_language(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where("doc_id % 3 <> 1"))
    held = language.predict(docs.where("doc_id % 3 = 1"), model).join(docs, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... 45"), (None, "the and of")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.predict(odd.where("doc_id is not null"), model).collect()] == [("und", 0.0)] * 3
    one, two = (docs.where(F.col("lang") == k).orderBy("doc_id").first().text[:400] for k in ("en", "de"))
    spans = model.spans(f"{one} {two}")
    assert [s[0] for s in spans] == ["en", "de"] and abs(spans[0][2] - len(one)) <= 30
    nothing = language.train(empty)
    assert language.predict(odd, nothing).where("lang_pred = 'und'").count() == 4
    assert language.predict(empty, model).count() == 0


def test_language_scripts(spark):
    rows = [(k, t, g) for k, (t, g) in enumerate([("слово мир дом", "ru"), ("word world house", "en")] * 30)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("дом word")[0] in ("ru", "en") and model.predict("мир")[0] == "ru" and model.predict("house")[0] == "en"


def test_language_fast_path_is_the_best_path(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    for r in docs.limit(20).collect():
        words = language.LETTERS.findall(r.text.lower())[:300]
        e, _ = model.scores(words)
        value = e[0].copy()
        for k in range(1, len(e)):
            value = np.maximum(value, value.max() - language.SWITCH) + e[k]
        path, _ = model.label(words)
        own = sum(e[k, p] for k, p in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert abs(own - value.max()) < 1e-6


def test_toxicity(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(d.where(queries.remainder("doc_id", 5) != 0), labels)
    rows = toxicity.score(d, model).join(labels.where("toxic is not null"), "doc_id").collect()
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum(p > n for p in pos for n in neg) / len(pos) / len(neg) > 0.95
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert toxicity.clean_documents(docs, model).columns == docs.columns
    none = toxicity.train(empty, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == 0


def test_registered_queries_and_pipeline(spark):
    import corpus_pipeline

    assert queries.QUERIES["op5_warc_archive"](spark, SF).count() > 0
    before = spark.read.parquet(f"{SF}/documents.parquet")
    kept = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == before.columns, name
    assert corpus_pipeline.run(spark, SF).where("length > 0").count() > 0
