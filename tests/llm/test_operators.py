"""Every operator against plain Python, and on awkward tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metaladder.llm import (
    attention, bpe_units, checksum, fingerprints, language_id, language_model, media, mixing, near_dedup, pieces,
    sentencepiece, storage, substring_dedup, token_records, warc,
)
from metaladder.llm.graph import connected_components
from metaladder.llm.queries import op9_fingerprints, tokenizer_path

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, hit int, topic string, TEXT string, component_id long"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioubcdst") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(60), make(150)
    words = base.split()
    near = [" ".join(w if rng.random() > 0.004 * k else "changed" for w in words) for k in range(8)]
    rows = [make(rng.randint(1, 120)) for _ in range(25)]
    rows += [base, base, base.upper(), *near, f"{make(10)} {passage} {make(9)}", f"{passage}\n{make(30)}", f"{make(3)}  {passage} {passage}"]
    rows += [None, "", "  \n\t ", "one", "one", "Ein Wort", "a\0b c", "日本 語 " * 30, "é" * 50, "%%% ###", "word " * 100, "x" * 3000, make(20_000), "tail\n"]
    return rows


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(_texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = [None, "en", "fr"]
    data = [(i, t, langs[i % 3], None if i % 7 == 0 else f"s{i % 4}", 0, 0.5, "b", 1, "t", "other", 9) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, a repeated row, and nothing else of note."""
    data = [(1, "same words here", None, None, None, None, None, None, None, None, None)] * 2 + [(None,) * 11, (2, None) + (None,) * 9]
    return spark.createDataFrame(data, SCHEMA)


def test_words_and_grams_match_plain_python(rows):
    for lower in (False, True):
        raw, at = [(t or "").encode() for _, t in rows], [0]
        for r in raw:
            at.append(at[-1] + len(r))
        from metaladder.llm import textops as T

        w = T.Words(np.frombuffer(b"".join(raw), np.uint8), np.array(at), lower)
        assert list(np.diff(w.first)) == [len(brute.words(t)) for _, t in rows]
        seen = {}
        flat = [x for _, t in rows for x in brute.words(t, lower)]
        for x, h in zip(flat, w.hash):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)
        for k in (1, 2, 3, 5, 20):
            g = {}
            for i, h in enumerate(T.grams(w.hash, k)):
                assert g.setdefault(tuple(flat[i : i + k]), h) == h
            assert len(set(g.values())) == len(g)


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute.near(rows)


def test_near_duplicates_at_the_threshold(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # chains whose links lie on both sides of 0.75
        cut = 20 + i % 8
        rows += [(2 * i, " ".join(f"{i}{w}" for w in words[:-10])), (2 * i + 1, " ".join(f"{i}{w}" for w in words[cut:]))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: c for d, (_, c, _) in brute.near(rows).items()}
    assert got == want and len(set(want.values())) < len(rows)


def _template_pairs(n, seed=4):
    """Documents on one template, 0.72 alike, in which pairs are 0.76 alike."""
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), 2 * n)
    base = " ".join(f"t{i}" for i in range(300))
    return [(d, " ".join([base, *(f"p{k // 2}x{i}" for i in range(9)), *(f"o{k}x{i}" for i in range(48))])) for k, d in enumerate(ids)]


def test_near_duplicates_on_a_template_below_the_threshold(spark):
    rows = _template_pairs(150)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: c for d, (_, c, _) in brute.near(rows).items()}
    assert len(set(want.values())) == 150 and got == want


def test_densified_bins_agree_in_proportion_to_similarity():
    rng = np.random.default_rng(1)
    rates = []
    for size in (6, 40, 400):
        same = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, size + size // 3, dtype=np.uint64)
            a, b = pool[:size], pool[size // 3 :]
            sig = near_dedup.signatures(np.repeat([0, 1], size), np.concatenate([a, b]), 2)
            same.append(((sig[0] == sig[1]).mean(), len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
        rates.append(np.mean([x - y for x, y in same]))
    assert np.abs(rates).max() < 0.05


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, x) for x in range(2001, 2100)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), storage.workspace(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), storage.workspace(spark, "t")).count() == 0


def test_repeats(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeats(rows)
    for length, gram in ((5, 2), (7, 7)):
        got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, length=length, gram=gram).collect()}
        assert got == {d: x[1] for d, x in brute.repeats(rows, length).items()}


def test_language_identification(spark):
    stems = {"en": "the and of hing tion er", "de": "der und ein sch keit ung", "es": "que los ción ando la ñ"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(stems[lang].split()) + rng.choice("aeiou") for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(rng.choices(list(stems), k=300))]
    rows += [(900, None, "en"), (901, "123 !!", "de"), (902, "", None), (903, "x" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out("doc_id", 5, 0))
    got = language_id.predict(docs, language_id.train(docs.filter("not held_out"))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[903].lang_pred in stems
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    nothing = language_id.train(docs.filter("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_checksums():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert slow(b"123456789") == 0xE3069283
    parts = [bytes(random.Random(n).randbytes(n)) for n in (0, 1, 255, 256, 257, 1000, 5, 4096)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    assert checksum.crc32c(np.frombuffer(b"".join(parts), np.uint8), at).tolist() == [slow(p) for p in parts]


def _byte_bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_units_give_the_ids_of_whole_texts(rows):
    texts = [t or "" for _, t in rows] + ["a.\nB c, d!!! e", "x́. y", "a.b's c", " a", "a  b", "<|endoftext|> x", "a\x1c b  c", "a  b", "1,2 3.x"]
    ids, at = bpe_units.Encoder(tokenizer_path("byte_bpe_50k.json"))(pa.array(texts, pa.string()))
    whole = _byte_bpe()
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_records(spark, docs, rows):
    files = token_records.write(docs, storage.workspace(spark, "t"), tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_records.read(files).collect()}
    whole, want, start = _byte_bpe(), {}, 0
    for d, t in sorted(rows):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    file = files.first()
    path = file.uri.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(token_records.records(file.uri, file.index_uri))


def test_pieces_equal_the_library(rows):
    import sentencepiece as library

    path = tokenizer_path("piece_bpe_32k.model")
    texts = [t for _, t in rows] + ["▁x ▁", "        deep    indent", "a" * 700, "<s> <0x41>", "ﬁ ① 😀", "\n\n x\n"]
    encoder, sp = pieces.Encoder(pieces.Model(path)), library.SentencePieceProcessor(model_file=path)
    ids, at = encoder(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t or ""), repr(t)
    assert pieces.decode(encoder.model, ids, at) == [(t or "").replace("▁", " ") for t in texts]


def test_sentencepiece_operator(docs, rows):
    made = sentencepiece.encode(docs, tokenizer_path("piece_bpe_32k.model"), ("n_tokens", "ids", "decoded", "exact")).collect()
    assert len(made) == len(rows) and all(r.exact and r.n_tokens == len(r.ids) for r in made)


def test_suffix_array_finds_all_occurrences():
    model = pieces.Model(tokenizer_path("piece_bpe_32k.model"))
    text = "the thing that these others gather " * 3
    codes = np.array([model.code_of[ord(c)] for c in text.replace(" ", pieces.SPACE)], np.uint64)
    order, keys = pieces.suffix_array(model, codes)
    low, high = pieces.bound(keys, model.low, False), pieces.bound(keys, model.high, True)
    marked = text.replace(" ", pieces.SPACE)
    for row in range(0, len(model.many), 97):
        piece = model.text[model.id[model.many[row]]]
        want = [i for i in range(len(marked)) if marked.startswith(piece, i)]
        assert sorted(order[low[row] : high[row]].tolist()) == want


def test_warc(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (3, "u\r\ny", None), (4, "", ""), (5, "q", "é" * 300_000), (6, "z", "x"), (7, "z", "y\r\n\r\nz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    archives = warc.write(pages, storage.workspace(spark, "t"))
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    got = {r.page_id: r for r in warc.read(archives).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        p, o, r = (h or "").encode(), last[h or ""], got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if o == i else "revisit", None if o == i else o)
        assert r.payload == (p if o == i else None)
    none = {r.page_id: r.refers_to for r in warc.read(warc.write(pages, storage.workspace(spark, "t"), min_revisit_bytes=1)).collect()}
    assert none[3] is None and none[4] is None and none[1] == 6


def test_warc_reader_rejects_damage():
    import io

    good = warc.build(1, "u", b"payload", None)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        warc.Frames(io.BytesIO(b"\0" * 16))


def test_media(docs, rows):
    got = {r.doc_id: r for r in media.store_and_read(docs).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for d, t in rows:
        raw = (t or "").encode()
        p, r = media.padded(raw), got[d]
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert by_text.setdefault(t or "", tuple(r)[1:]) == tuple(r)[1:]


def test_cuts_depend_on_content():
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, 200_000, dtype=np.uint8)
    ends = media.cuts(raw)
    size = np.diff([0, *ends])
    assert ends[-1] == len(raw) and size.max() <= media.MAX and size[:-1].min() >= media.MIN
    moved = media.cuts(np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), raw]))
    assert len({e + 777 for e in ends} & set(moved)) > len(ends) // 2
    h = media.gear(raw[:100])
    assert int(h[50]) == sum(int(media.GEAR[raw[50 - j]]) << j for j in range(32)) % (1 << 32)


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.with_neighbours(docs).collect()}
    assert len(got) == len(rows)
    parts = lambda s: [s[i : i + 4] for i in range(0, len(s), 4)]
    off = []
    for k, (d, t) in enumerate(rows):
        nd, nt = rows[(k + 1) % len(rows)]
        t, nt, r = t or "", nt or "", got[d]
        n = len(t) // 4
        new = t[: len(t) - n] + nt[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b = parts(r.fingerprint), parts(got[nd].fingerprint)
        assert r.near_next == np.mean([x == y for x, y in zip(a, b)])
        p, q = brute.shingles(t), brute.shingles(new)
        if p or q:
            off.append(r.near_edited - len(p & q) / len(p | q))
    assert abs(np.mean(off)) < 0.05
    equal = [got[d].fingerprint for d, t in rows if t == "one"]
    assert len(set(equal)) == 1


def test_similar_pairs_are_verified(docs, rows):
    pairs = {(r.a, r.b) for r in fingerprints.similar(docs).collect()}
    sets = {d: brute.shingles(t) for d, t in rows}
    assert pairs and all(a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in pairs)


def test_op9_query_finds_every_class(spark, tmp_path):
    rows = _template_pairs(100)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in op9_fingerprints(spark, str(tmp_path)).collect()}
    want = {d: c for d, (_, c, _) in brute.near(rows).items()}
    assert len(set(want.values())) == 100 and got == {d: (c, 1) for d, c in want.items()}


def _network(n=32, seed=0):
    rng = np.random.default_rng(seed)
    p = {k: v.astype(np.float64) for k, v in attention.initial(rng.integers(0, 50, (n + 1, n)).astype(float)).items()}
    for k in ("near", "group", "member"):
        p[k] = rng.standard_normal(p[k].shape)
    return p


def test_attention_scores_each_id_as_plain_python_does():
    p, rng = _network(), np.random.default_rng(3)
    ids = rng.integers(0, 32, 70)
    want = brute.attention(p, ids, attention.BLOCK)
    full = attention.log_probabilities(p, ids, np.array([0, 70]))
    assert np.allclose(full, want, atol=1e-5)
    for n in (1, 15, 16, 17, 40):  # what follows changes nothing
        assert np.allclose(attention.log_probabilities(p, ids[:n], np.array([0, n])), full[:n], atol=1e-5)
    two = attention.log_probabilities(p, np.concatenate([ids, ids[:5]]), np.array([0, 70, 75]), step=2)
    assert np.allclose(two[70:], full[:5], atol=1e-5) and np.allclose(two[:70], full, atol=1e-5)
    last = [attention.log_probabilities(p, np.append(ids[:20], x), np.array([0, 21]))[-1] for x in range(32)]
    assert abs(np.exp(last).sum() - 1) < 1e-4


def test_attention_with_scores_that_would_overflow():
    p = _network()
    p["q"], p["k"] = p["q"] * 40, p["k"] * 40
    ids = np.random.default_rng(4).integers(0, 32, 50)
    assert np.allclose(attention.log_probabilities(p, ids, np.array([0, 50])), brute.attention(p, ids, attention.BLOCK), atol=1e-4)


def test_attention_gradients():
    p, rng = _network(), np.random.default_rng(1)
    inputs, before, first, targets, real = attention.layout(rng.integers(0, 32, 40), np.array([0, 40]), 32)
    loss = lambda: -(attention.forward(p, inputs, before, first, targets)[0] * real).sum() / real.sum()
    grads = attention.backward(p, inputs, real.astype(np.float64), attention.forward(p, inputs, before, first, targets)[1])
    assert set(grads) == set(p) - set(attention.FIXED)
    for name, g in grads.items():
        for place in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(rng.integers(0, n) for n in g.shape)]:
            p[name][place] += 1e-5
            up = loss()
            p[name][place] -= 2e-5
            down = loss()
            p[name][place] += 1e-5
            assert abs((up - down) / 2e-5 - g[place]) < 1e-4, name


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_language_model(docs, rows, head, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", head)
    marked = docs.withColumn("held_out", language_id.held_out("doc_id", 7, 2))
    got = language_model.score(marked).collect()
    tokens = {d: [*brute.words(t, True), None] for d, t in rows}
    c = Counter()
    for d, ws in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0


def test_language_model_does_not_follow_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD", 4000)  # several shards a round
    monkeypatch.setattr(language_model, "RUN", 300)
    rng = random.Random(8)
    rows = [(d, " ".join(f"w{rng.randint(0, 40)}" for _ in range(800)), d % 5 == 0) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    seen, plain = [], language_model._round
    monkeypatch.setattr(language_model, "_round", lambda *a: seen.append(plain(*a)) or seen[-1])
    scores = [{r.doc_id: r.score for r in language_model.score(docs.repartition(n)).collect()} for n in (1, 8, 64)]
    assert len(scores[0]) == 60 and all(math.isclose(x, other[d], rel_tol=1e-8) for other in scores[1:] for d, x in scores[0].items())
    last = [seen[language_model.ROUNDS * (k + 1) - 1][0] for k in range(3)]  # the networks are the same to the bit
    assert all((last[0][name] == x[name]).all() for x in last[1:] for name in last[0])
    # Every block of the training documents is trained on, once.
    runs = [min(300, 801 - lo) for _, _, out in rows if not out for lo in range(0, 801, 300)]
    assert sum(n for _, n in seen[: language_model.ROUNDS]) == sum(-(-n // attention.BLOCK) for n in runs)
    assert np.abs(seen[language_model.ROUNDS - 1][0]["member"]).max() > 0


def test_language_model_beats_its_bigrams_on_held_out_text(spark, monkeypatch):
    rng = random.Random(6)
    starts = ["ab", "cd", "ef", "gh"]

    def text():  # the second next word follows from this one, the next does not
        out = [rng.choice(starts), rng.choice(starts)]
        while len(out) < 1500:
            out.append(starts[(starts.index(out[-2]) + 1) % 4])
        return " ".join(out)

    rows = [(d, text(), d % 4 == 0) for d in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    held = lambda: sum(r.score for r in language_model.score(docs).collect() if r.held_out)
    learnt = held()
    monkeypatch.setattr(language_model, "_round", lambda gathered, network, *_: (network, 0))
    assert learnt > 0.97 * held()


def test_language_model_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 1)
    rows = [(1, "a b c", False), (1, "c d d", False), (1, "a b c", False), (2, "b", True), (2, None, True)]
    got = language_model.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()
    c = Counter([w for _, t, out in rows if not out for w in t.split()] + [None] * 3)
    n, v = sum(c.values()), len(c)
    want = sorted((d, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*(t or "").split(), None])) for d, t, _ in rows)
    assert all(x[0] == y[0] and math.isclose(x[1], y[1]) for x, y in zip(sorted((r.doc_id, r.base_score) for r in got), want))


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(8)
    cells = [(s, lang, t, rng.randint(2000, 90_000)) for s in "abcd" for lang in ("x", "y") for t in ("p", "q", "r")]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    wanted = {"source": 0.5, "lang": {"x": 3, "y": 1}, "topic": 1.0}
    got = mixing.rake(table, storage.workspace(spark, "t"), wanted=wanted, fraction=0.1, rounds=8).collect()
    total = sum(r.weight for r in got)
    by = lambda k: {v: sum(r.weight for r in got if r[k] == v) / total for v in {r[k] for r in got}}
    assert abs(by("lang")["x"] - 0.75) < 1e-3
    held = {s: sum(c[3] for c in cells if c[0] == s) ** 0.5 for s in "abcd"}
    for s, share in by("source").items():
        assert abs(share - held[s] / sum(held.values())) < 2e-3
    assert all(0 <= r.probability <= 1 for r in got)


def test_mixing_draws_by_probability(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0.37).alias("p"))
    share = many.filter(mixing.drawn(F.col("doc_id"), F.col("p"))).count() / 20_000
    assert abs(share - 0.37) < 0.015


def test_mixing_keeps_rows_and_columns(docs, rows):
    got = mixing.mix(docs, rounds=2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(brute.words(dict(rows)[r.doc_id])) and r.bucket == "b"
        assert not (r.selected and r.n_tokens == 0)


OPERATORS = {
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "repeats": lambda s, d: substring_dedup.remove_repeats(d),
    "media": lambda s, d: media.store_and_read(d),
    "records": lambda s, d: token_records.read(token_records.write(d, storage.workspace(s, "t"), tokenizer_path("byte_bpe_50k.json"))),
    "fingerprints": lambda s, d: fingerprints.with_neighbours(d),
    "classes": lambda s, d: fingerprints.with_classes(d),
    "model": lambda s, d: language_model.score(d.withColumn("held_out", F.lit(False))),
    "language": lambda s, d: language_id.predict(d, language_id.train(d)),
    "mixing": lambda s, d: mixing.mix(d, rounds=1),
    "sentencepiece": lambda s, d: sentencepiece.encode(d, tokenizer_path("piece_bpe_32k.model")),
    "warc": lambda s, d: warc.read(warc.write(storage.unclashed(d, "text").selectExpr("doc_id as page_id", "source as url", "text as html", "hit as payload"), storage.workspace(s, "t"))),
}
#: Operators that pass rows without an id through.
KEEP_NULL_IDS = {"language", "mixing", "sentencepiece"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_repeated_rows(spark, odd, name):
    assert OPERATORS[name](spark, odd).count() == (4 if name in KEEP_NULL_IDS else 3)


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids that stand for several texts, some of them the same or near, and long unbroken ones."""
    rng = random.Random(12)
    make = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    c, e, long = make(300), make(300), make(9000)
    rows = [(3, c), (4, e), (7, c), (7, e), (7, long), (7, make(9000)), (8, long), (9, "x" * 200_000), (9, None), (9, "x" * 200_000), (10, make(50))]
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "b", 1, "t", "o", 9) for i, t in rows], SCHEMA).repartition(3), rows


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_with_several_texts(spark, repeated, name):
    docs, rows = repeated
    assert OPERATORS[name](spark, docs).count() == len(rows)


def test_what_becomes_of_ids_with_several_texts(spark, repeated):
    docs, rows = repeated
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    same = {3: 3, 4: 3, 7: 3, 8: 3, 9: 9, 10: 10}  # 7 holds texts of 3, 4 and 8
    assert got == sorted((d, len(brute.shingles(t)), same[d]) for d, t in rows)
    stored = media.store_and_read(docs).collect()
    assert Counter((r.doc_id, r.payload_sha256) for r in stored) == Counter((d, hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for d, t in rows)
    order = sorted(rows, key=lambda r: (r[0], zlib.crc32((r[1] or "").encode())))
    for parts in ("1", "4"):  # several files may hold one id
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        read = token_records.read(token_records.write(docs, storage.workspace(spark, "t"), tokenizer_path("byte_bpe_50k.json"))).orderBy("start").collect()
        whole, at = _byte_bpe(), 0
        for r, (d, t) in zip(read, order):
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    order = sorted(rows, key=lambda r: (r[0], (r[1] or "").encode()))
    want = Counter()
    for k, (d, t) in enumerate(order):
        t, nt = t or "", order[(k + 1) % len(order)][1] or ""
        want[d, hashlib.sha256((t[: len(t) - len(t) // 4] + nt[: len(t) // 4]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.with_neighbours(docs).collect()) == want


def test_fingerprints_are_minhashes(docs, rows):
    a, b = (x.tolist() for x in fingerprints.permutations(fingerprints.PERMUTATIONS))
    for r in fingerprints.with_neighbours(docs).collect():
        text = dict(rows)[r.doc_id]
        from metaladder.llm import textops as T

        raw = (text or "").encode()
        _, hashes = T.shingle_sets(T.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True), 5)
        if len(raw) > 5000:
            continue
        plain = [min(((x * p + q) % (2**31 - 1) for x in (int(h) % (2**31 - 1) for h in hashes)), default=0xFFFF) & 0xFFFF for p, q in zip(a, b)]
        assert r.fingerprint == "".join(f"{x:04x}" for x in plain)


def test_windows_beyond_one_stretch(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 64)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeats(rows)


def test_anchors_of_more_words_than_a_position_holds():
    from types import SimpleNamespace

    n = (1 << 24) + 100
    words = SimpleNamespace(hash=np.random.default_rng(0).integers(0, 1 << 63, n, dtype=np.uint64), row=np.zeros(n, np.int8))
    at, place, g = substring_dedup.anchors(words, 20, 6)
    assert len(at) == n - 19 and ((place >= at) & (place <= at + 14)).all()
    for k in [0, (1 << 22) - 1, 1 << 22, (1 << 24) + 50]:
        assert g[place[k]] >> np.uint64(24) == (g[k : k + 15] >> np.uint64(24)).min()


def test_language_scores_are_naive_bayes(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(s) for _ in range(40)), s[:2]) for i in range(60) for s in ("abcde fg", "bcdxy zq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    counts = {}
    grams = lambda t, k: [int(language_id.hashed(np.array([ord(c) for c in f" {t} "[i : i + k]], np.uint32), k, language_id.BUCKETS)[0]) for i in range(len(t) + 3 - k)]
    for _, t, lang in rows:
        counts.setdefault(lang, Counter()).update(g for k in language_id.ORDERS for g in grams(t, k))
    logs = lambda lang, t: sum(math.log((counts[lang][g] + language_id.SMOOTHING) / (sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS)) for k in language_id.ORDERS for g in grams(t, k))
    for r in language_id.predict(docs, model).collect():
        each = {lang: logs(lang, r.text) for lang in counts}
        assert r.lang_pred == max(each, key=each.get) and abs(r.score - 1 / sum(math.exp(v - max(each.values())) for v in each.values())) < 1e-3


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs.limit(3)).languages) == 3
    with pytest.raises(ValueError):
        language_id.train(docs)


def test_bloom_filter_keeps_every_id(spark):
    texts = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    kept = {r.doc_id for r in near_dedup.narrowed(texts, spark.range(0, 5000, 50)).collect()}
    assert kept >= set(range(0, 5000, 50)) and len(kept) < 110


def test_automaton_finds_longest_matches():
    from metaladder.llm.automaton import Automaton

    rng = random.Random(9)
    for _ in range(40):
        sequences = [[rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 4))]
        text = [rng.randrange(4) for _ in range(40)]
        parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max((k for k in range(1, e + 2) if tuple(text[e + 1 - k : e + 1]) in parts), default=0) for e in range(len(text))]
        assert Automaton(sequences).statistics(text) == want


def test_reference_passages_are_removed(spark, docs, rows):
    from metaladder.llm.automaton import remove_reference

    texts = [t for _, t in rows if t and len(t.split()) > 60][:3]
    reference = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    for length in (5, 20):
        windows = {tuple(w[i : i + length]) for t in texts for w in [brute.words(t)] for i in range(len(w) - length + 1)}
        for r in remove_reference(docs, reference, length=length).collect():
            w = brute.words(dict(rows)[r.doc_id])
            gone = [False] * len(w)
            for i in range(len(w) - length + 1):
                if tuple(w[i : i + length]) in windows:
                    gone[i : i + length] = [True] * length
            assert (r.n_words, r.n_removed) == (len(w), sum(gone))
            assert r.kept_text.encode() == b" ".join(x for x, g in zip(w, gone) if not g)
    with pytest.raises(ValueError):
        remove_reference(docs, spark.createDataFrame([("x " * 2_000_001,)], "text string"))


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    make = lambda lang, n: " ".join(rng.choice(lang) + rng.choice("bcdfg") * rng.randint(1, 4) + rng.choice("aeiou") for _ in range(n))
    stems = {"en": ["the", "hing"], "fr": ["le", "eaux"]}
    clash = ["score", "lang_pred", "topic", "n_tokens", "probability", "selected", "n_removed", "kept_text", "left", "hit", "comp", "component_id", "kept", "ids", "mix_p", "text_hash"]
    rows = [(i, make(stems[k], 80), k, "s", 7) for i, k in enumerate(["en", "fr"] * 10)] + [(None, make(stems["en"], 90), "en", "s", 7), (3, make(stems["en"], 70), "en", "s", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in clash))
    now = table
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, storage.materialise(stage(spark, now, str(tmp_path)), f"file://{tmp_path}/clash", name)
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0, name
        if name != "sentencepiece":
            assert now.columns == table.columns
            assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for r in now.collect() for c in clash), name
        if name in ("near_dedup", "substring_dedup"):  # nothing here is near another or repeats
            assert sorted((r.text, r.n_chars) for r in now.collect()) == sorted((t, n) for _, t, _, _, n in rows)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    stems = {"en": ["the", "and", "hing", "tion"], "fr": ["le", "et", "aux", "ment"]}
    make = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice("bcdfg") * rng.randint(0, 3) + rng.choice("aeiou") for _ in range(n))
    passage, base = make("en", 70), make("en", 200)
    data = [(i, make("en" if i % 3 else "fr", 60), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(60)]
    data += [(100, base, "en", "s0"), (101, base, "en", "s1"), (102, base + " more", "en", "s1"), (103, make("en", 30) + " " + passage, "en", "s2"), (104, passage + " " + make("en", 40), "en", "s2"), (105, "12 34 !!", "en", "s0"), (106, None, None, None)]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        now = storage.materialise(stage(spark, now, str(tmp_path)), f"file://{tmp_path}/run", name)
        seen[name] = {r.doc_id: r for r in now.collect()}
        assert now.columns == (table.columns if name != "sentencepiece" else ["doc_id", "source", "lang", "n_tokens", "ids"])
    clean = {i for i in range(60)} | {100, 103, 104}
    assert set(seen["language_id"]) == clean | {101, 102} and set(seen["near_dedup"]) == clean
    cut = seen["substring_dedup"]
    assert set(cut) == clean and passage in cut[103].text and passage not in cut[104].text and cut[104].n_chars == len(cut[104].text)
    want = {d: brute.repeats([(x, y.text) for x, y in seen["near_dedup"].items()])[d] for d in clean}
    assert all(hashlib.sha256(" ".join(cut[d].text.split()).encode()).hexdigest() == want[d][2] for d in clean)
    assert 0 < len(seen["mixing"]) < len(clean) and set(seen["sentencepiece"]) == set(seen["mixing"])
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, tuple(r.ids)) for r in ran.collect()} == {(r.doc_id, tuple(r.ids)) for r in seen["sentencepiece"].values()}
