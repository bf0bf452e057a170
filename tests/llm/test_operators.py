"""Operators against brute force, exact libraries, or held-out labels."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corrweave.llm import bpe, fingerprints, language, near_dedup, packing, pieces, pii, quality, search, token_counts, wrappers

SMALL = "/root/testdata/sf0.01"


def test_fingerprints_edit_and_likeness(spark, documents):
    docs = sorted(((r.doc_id, r.text or "") for r in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_likeness(documents).collect()}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        third = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1
    of_text = {t: got[i].fingerprint for i, t in docs}
    assert all(got[i].fingerprint == of_text[t] for i, t in docs)


def test_block_tables_find_all_neighbours(spark):
    r = np.random.default_rng(1)
    base = int.from_bytes(r.bytes(16), "big")
    prints = [f"{base ^ sum(1 << int(b) for b in r.choice(128, k, replace=False)):032x}" for k in (0, 1, 2, 3, 3, 4, 6) for _ in range(4)]
    df = spark.createDataFrame([(p,) for p in prints + [None]], "fingerprint string")
    got = {(x.query, x.match, x.distance) for x in fingerprints.neighbours(df, df, 3).collect()}
    want = {(a, b, n) for a in prints for b in prints if (n := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want


def test_block_tables_count_all_neighbours(spark):
    """With keys that many share, split or not, and runs that go over batches."""
    r = np.random.default_rng(6)
    seeds = [int.from_bytes(r.bytes(16), "big") for _ in range(6)]
    prints = {f"{s ^ sum(1 << int(b) for b in r.choice(128, k, replace=False)):032x}" for s in seeds for k in (0, 1, 1, 2, 2, 3) for _ in range(12)}
    shared = seeds[0] >> 96 << 96  # many fingerprints with one first block
    prints |= {f"{shared | int.from_bytes(r.bytes(12), 'big'):032x}" for _ in range(300)}
    df = spark.createDataFrame([(p,) for p in [*prints, next(iter(prints))]] + [(None,)], "fingerprint string")
    numbers = {p: int(p, 16) for p in prints}
    for radius in (0, 3, 5):
        want = {p: n for p, a in numbers.items() if (n := sum(0 < (a ^ b).bit_count() <= radius for b in numbers.values()))}
        for long in (16, 100_000):
            assert {x.fingerprint: x.n_near for x in fingerprints.near_counts(df, radius, long).collect()} == want, (radius, long)


def test_ring_of_rows_without_ids(spark):
    """Each text is the next of exactly one row, whatever the ids, ties and nulls."""
    rows = [(i // 2, f"text {i} " * 3) for i in range(60)] + [(None, f"none {i} " * 3) for i in range(60)] + [(None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprints.with_next(df, 5).collect()
    assert sorted(r.next_text for r in got) == sorted(t or "" for _, t in rows)
    ids = sorted(((r.doc_id, r.text, r.next_text) for r in got if r.doc_id is not None), key=lambda x: (-x[0], x[1]))
    assert all(a[2] == b[1] for a, b in zip(ids, ids[1:]))
    alone = fingerprints.with_next(df.limit(1)).first()
    assert alone.next_text == alone.text


def test_votes_by_hand(spark, documents):
    """Bits, likeness and neighbours recomputed one document at a time."""
    got = fingerprints.edited_likeness(documents).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    distinct = set(prints.values())
    order = sorted(prints, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for r in got:
        assert np.isclose(r.near_edited, 1 - (prints[r.doc_id] ^ int(r.edited_fingerprint, 16)).bit_count() / 128)
        assert np.isclose(r.near_next, 1 - (prints[r.doc_id] ^ prints[after[r.doc_id]]).bit_count() / 128)
        assert r.n_near == sum(0 < (prints[r.doc_id] ^ p).bit_count() <= 3 for p in distinct)


def page(i, body):
    return f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='main'><h1>Story {i}</h1><p>{body}</p><p>Always the same line.</p></div><script>x=1</script><footer>All rights {i}</footer></body></html>"


def test_wrappers(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"Body &amp; words\n of page {i}, long enough to be the article.")) for i in range(8)] + [(9, None, None)]
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert "Body & words of page 3, long enough to be the article." in got[3].text
    assert not re.search("Home|rights|x=1", got[3].text)
    assert (got[9].text, got[9].n_chars) == ("", 0)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_parser_needs_the_fewest_longest_phrases():
    source, text = "abracadabra", "abraxabracad"
    p = language.Parser((("a", (source,)),))
    n, at = 0, 0
    while at < len(text):
        size = max((k for k in range(1, len(text) - at + 1) if text[at : at + k] in source), default=1)
        n, at = n + 1, at + size
    assert np.isclose(p.rates([text])[0, 0], n * p.bits[0] / len(text))


def test_phrases_go_on_over_any_length():
    """Long texts, periodic ones too, in batches of unlike lengths, against the parse of one text after another."""
    r = np.random.default_rng(8)

    def prose(n, letters="abcde "):
        return "".join(r.choice(list(letters), n))

    sources = {"a": prose(900), "b": "ab" * 700 + prose(300, "abz"), "c": prose(50, "xyz") + "a" * 900}
    p = language.Parser(tuple((k, (v,)) for k, v in sources.items()))
    texts = ["ab" * 2000, "a" * 5000, prose(3000), prose(1025, "abxyz"), "z", "", "aab" * 1200 + prose(700), sources["a"] * 3, "b" * 512, "ab" * 256 + "z"]
    found = p.rates(texts)
    for i, text in enumerate(texts):
        for k, (_, source) in enumerate(sources.items()):
            text_, source_ = ("".join(map(chr, p.symbols(x).tolist())) for x in (text, source))
            n, at = 0, 0
            while at < len(text_):
                size = 1
                while at + size < len(text_) and text_[at : at + size + 1] in source_:
                    size += 1
                n, at = n + 1, at + size
            assert np.isclose(found[i, k], n * p.bits[k] / max(1, len(text_))), (i, k)


def test_pieces_as_brute_force(spark, documents):
    """The best score over every way to cut a text into pieces, by trying all pieces that end at each place."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        model.ParseFromString(f.read())
    score = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
    longest, unknown = max(map(len, score)), min(score.values()) - 10
    codec = pieces.load(pieces.default_path())
    texts = [(r.text or "")[:200] for r in documents.collect()] + ["", " ", "  two  spaces ", "☃ snow\n\tTab", "𝔘"]
    for t in texts:
        s = codec.normalise(t)
        best = [0.0]
        for j in range(1, len(s) + 1):
            best.append(max(best[i] + score.get(s[i:j], unknown if j - i == 1 else float("-inf")) for i in range(max(0, j - longest), j)))
        ours, at = 0.0, 0
        ids = codec.encode(t)
        while at < len(ids):
            p = model.pieces[ids[at]]
            if p.type == 6:  # the bytes of one unknown character
                lead = int(p.piece[3:-1], 16)
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                ours += unknown
            else:
                at, ours = at + 1, ours + p.score
        assert ours == best[-1]
        assert codec.decode(ids) == t
    assert all(r.round_trip for r in pieces.encoded_digests(documents).collect())


def brute_components(rows):
    prints = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_near_dedup_as_brute_force(spark, documents):
    want = brute_components([(r.doc_id, r.text) for r in documents.collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dedup.near_duplicates(documents).collect()}
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


def test_links_connect_what_all_pairs_would(spark):
    r = np.random.default_rng(5)
    base = int(r.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in r.choice(60, k, replace=False)) for k in (1, 2, 3, 4, 5) for _ in range(60)})
    links = near_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()
    assert all(0 < (x.a ^ x.b).bit_count() <= 3 for x in links)

    def groups(pairs):
        parent = {f: f for f in fps}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        return [root(f) for f in fps]

    assert groups((x.a, x.b) for x in links) == groups((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)


def test_top_k_as_brute_force(spark):
    r = np.random.default_rng(2)
    v = r.integers(-3, 4, (700, 4)) / 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    w = np.floor(1024 * v).astype(np.int64)
    want = []
    for q in range(0, 700, 100):
        order = sorted((-int(w[q] @ w[i]), i) for i in range(700) if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    got = search.top_k(df, block=128, query_block=4).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in got] == want


def test_top_k_of_clusters_meets_few_cells(spark, monkeypatch):
    """Clusters far apart, one of them with a third of all rows as one vector: most pairs of group and cell never meet."""
    r = np.random.default_rng(6)
    v = np.concatenate([r.integers(-3, 4, (200, 6)) + 900 * c for c in np.eye(6, dtype=int)])
    v[:400] = v[0]
    v = v[r.permutation(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v / 1024)], "vec_id bigint, embedding array<double>")
    want = []
    for q in range(0, len(v), 20):
        order = sorted((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    written = {}
    plain = search.stored
    monkeypatch.setattr(search, "stored", lambda rows, kind: written.setdefault(kind, plain(rows, kind)))
    got = search.top_k(df, every=20, block=50, query_block=3).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in got] == want
    cells, groups = written["cells"].count(), written["groups"].count()
    met = written["meetings"].select("dim", "grp", "cell").distinct().count()
    assert cells > 6 and met < 0.5 * cells * groups


def test_top_k_in_many_passes(spark, monkeypatch):
    """Pieces of groups over several passes, and components so large that products pass a double's whole numbers."""
    r = np.random.default_rng(8)
    for scale, dim in ((1, 3), (10**7, 5)):
        w = r.integers(-4, 5, (400, dim)) * scale
        df = spark.createDataFrame([(i, (x / 1024).tolist()) for i, x in enumerate(w)], "vec_id bigint, embedding array<double>")
        want = []
        for q in range(0, 400, 10):
            order = sorted((-sum(int(a) * int(b) for a, b in zip(w[q], w[i])), i) for i in range(400) if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
        monkeypatch.setattr(search, "PASS_PIECES", 3)
        asked, plain = [], search._Asked.__init__
        monkeypatch.setattr(search._Asked, "__init__", lambda self, *x: asked.append(self) or plain(self, *x))
        got = search.top_k(df, every=10, block=64, query_block=4).orderBy("query_id", "rank").collect()
        assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in got] == want
        assert len(asked) > 2 and all(len(a.pieces) <= 3 for a in asked)
        monkeypatch.setattr(search._Asked, "__init__", plain)


def test_top_k_shuffles_alike_for_any_number_of_groups(spark, monkeypatch):
    """Data are written in order of their cells once: as many rows whether queries are one group or many."""
    v = np.random.default_rng(9).integers(-9, 10, (600, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v / 1024)], "vec_id bigint, embedding array<double>")
    plain, sizes, found = search.stored, [], []
    for query_block in (1000, 5):
        written = {}
        monkeypatch.setattr(search, "stored", lambda rows, kind: written.setdefault(kind, plain(rows, kind)))
        found.append(search.top_k(df, every=5, block=64, query_block=query_block).orderBy("query_id", "rank").collect())
        sizes.append((written["data"].count(), written["queries"].count(), written["groups"].count()))
    assert found[0] == found[1] and len(found[0]) == 1200
    assert sizes[0][:2] == sizes[1][:2] == (600, 120) and sizes[0][2] == 1 < sizes[1][2]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def plain_score(m, bag):
    """One bag's score, passage by passage."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    hidden = [np.tanh(m.p["W"].T @ ((row - m.shift) / m.scale) + m.p["b"]) for row in bag]
    said = [float(m.p["w"] @ (np.tanh(m.p["V"].T @ h) * sigmoid(m.p["U"].T @ h))) for h in hidden]
    share = np.exp(said) / np.exp(said).sum()
    return float(sigmoid(m.p["c"] @ sum(s * h for s, h in zip(share, hidden)) + m.p["d"])[0])


def test_attention_slopes_and_scores():
    r = np.random.default_rng(3)
    n = np.array([1, 4, 2, 7, 3])
    x, y, weight = r.normal(size=(n.sum(), quality.TRAITS)), np.array([0.0, 1, 1, 0, 1]), r.uniform(0.1, 1, 5)
    m = quality.AttentionMil(width=5, gates=3)
    bags = np.split(x, np.cumsum(n)[:-1])
    assert np.allclose(m.score(x, n), [plain_score(m, bag) for bag in bags], rtol=1e-12)

    def loss():
        s = np.array([plain_score(m, bag) for bag in bags])
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    for k, slope in m._gradient(x, n, y, weight).items():
        flat, want = m.p[k].reshape(-1), slope.reshape(-1)
        for i in range(len(flat)):
            kept = flat[i]
            flat[i] = kept + 1e-6
            above = loss()
            flat[i] = kept - 1e-6
            below, flat[i] = loss(), kept
            assert np.isclose((above - below) / 2e-6, want[i], rtol=1e-4, atol=1e-8), (k, i)


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, n, y = r.normal(size=(40, quality.TRAITS)), np.full(10, 4), np.arange(10) % 2
    x[:, 0] += np.repeat(y, 4) * 3
    m = quality.AttentionMil().fit(x, n, y.astype(float), steps=80)
    assert ((m.score(x, n) > 0.5) == y).all()


def test_token_counts_and_cache(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    more = documents.select("doc_id", "text").union(spark.createDataFrame([(-1, "<|endoftext|>a"), (-2, None), (-3, "ﬁ   x𝔘́")], "doc_id bigint, text string"))
    cache = str(tmp_path / "cache")
    texts = {r.doc_id: r.text or "" for r in more.collect()}
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(more, cache).collect()}
        want = {i: (len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts.items()}
        assert got == want
        assert spark.read.parquet(cache).count() == spark.read.parquet(cache).select("digest").distinct().count()


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def brute_spans(t):
    return sorted((m.start(), k, m.end()) for k, (p, fine) in enumerate(BASE.values()) for m in re.finditer(p, t) if fine(m.group()))


def test_base_spans(documents):
    texts = [r.text or "" for r in documents.collect()]
    texts += ["a@b.c@d.e x", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "+1 (555) 123-4567 4111 1111 1111 1111", "@@a@b-.c.", "9" * 40, "a..b@c.d.e."]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)


def test_disguises_map_back():
    for t, part, kind in (
        ("write jоhn@ехample.org now", "jоhn@ехample.org", "email"), ("mail ann [at] site [dot] org please", "ann [at] site [dot] org", "email"),
        ("ann dot lee at site dot org", "ann dot lee at site dot org", "email"), ("host 10 dot 0 dot 0 dot 1 up", "10 dot 0 dot 0 dot 1", "ip"),
    ):
        found = {(pii.KINDS[k], t[s:e]) for s, k, e in pii.all_spans(t, pii.base_spans(t))}
        assert (kind, part) in found
    for clean in ("He lives at home. The dot on the map is at point two.", "one two buckle my shoe"):
        assert pii.all_spans(clean, pii.base_spans(clean)) == []


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    rows = packing.pack(documents).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for d in documents.collect():
        ids, at = lib.encode(d.text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.piece):
            assert r.start == at and (r.length == 1024 or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.1 * -(-sum(r.length for r in rows) // 1024) + 1


def test_bins_of_random_histograms():
    r = np.random.default_rng(4)
    for _ in range(50):
        h = {int(n): int(c) for n, c in zip(r.integers(1, 101, 20), r.integers(1, 30, 20))}
        plan = packing.plan_bins(dict(h), 100)
        held = defaultdict(int)
        for many, lengths in plan:
            assert many > 0 and sum(lengths) <= 100 and sum(3 * n > 100 for n in lengths) <= 2
            for n in lengths:
                held[n] += many
        assert dict(held) == h


def test_components_of_a_chain(spark):
    from corrweave.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.limit(0)).select(F.count("*")).first()[0] == 0
