"""Each operator on a small odd table against a direct computation."""

import hashlib
import io
import json
import math
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import rows
from quillwave.llm import archive, bpe, neardup, packing, pii, quality, queries, scoring, tokenfile, topk, webtext

ODD = [
    None, "", " ", "\n \t", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>c", "it's I'LL don’t naïve İstanbul ΣΑΣ",
    "\x1ca\x1f \x85 nbsp　日本語 １２３ ½ é", "aaaaaaaaaaaa !!!!!!!!! ------ ====", "a\tb\nc\r\n d\x0b", "a \n b", "a\n b ",
    "a b.\nC d.\n\nE x,\nY é. ... a., 'tis.\nIt's We're! x!! q.\nz.\nw", "😀👍🏽 👩‍👩‍👧", "9" * 3000, "word " * 3000,
    "x1@y.com 10.0.0.1 4111 1111 1111 1111 +1 (017) 555-7713", "é😀q@r.st, 1.2.3.4.5.6.7.8 256.1.1.1 a@b a@b.c_d@e.f",
    "$$$ *** ### a b c d e a b c d e a b c d e", "same line\nsame line\n\n\nother",
]


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["th", "in", "er", "an", "re"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


def near(text, seed, edits):
    held, draw = text.split(), random.Random(seed)
    for _ in range(edits):
        held[draw.randrange(len(held))] = f"edit{draw.randrange(999)}"
    return " ".join(held)


BASE = [words(i, 120) for i in range(12)]
TEXTS = ODD + BASE + [near(BASE[i % 3], 100 + i, i % 7) for i in range(45)] + [BASE[0]] * 20


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `_text` string"
    return spark.createDataFrame(data, schema).repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def library(name):
    return Tokenizer.from_file(name)


def test_bpe(docs, none):
    lib = library(queries.WORD_BPE)
    got = {r.doc_id: r for r in bpe.encode_decode(docs, queries.WORD_BPE).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == " ".join(map(str, ids)) and got[i].n_tokens == len(ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.digests(bpe.encode_decode(none, queries.WORD_BPE)).collect() == []


def test_wrapper():
    a, b = ("<body><nav><a>m</a></nav><article><h1>t</h1>%s</article><div class=comments>c</div></body>" % x for x in ("<p>x<p>y", "<p>z<ul><li>k</ul>"))
    wrapper = webtext.merged(webtext.skeleton(webtext.parse(a)), webtext.skeleton(webtext.parse(b)))
    assert webtext.expression(wrapper) == (
        "<html><body><nav>#</> <article><h1>#</> <p>#</>+ <ul><li>#</></>?</> <div.comments>#</></></>"
    )
    pattern = webtext.Pattern(wrapper)
    found = [(s, webtext.text_of(n)) for page in (a, b) for s, n in pattern.match(webtext.parse(page))]
    assert found == [(0, "m"), (1, "t"), (2, "x"), (2, "y"), (4, "c"), (0, "m"), (1, "t"), (2, "z"), (3, "k"), (4, "c")]
    facts = {k: webtext.Facts(2, 9, 0, False) for k in range(5)}
    assert webtext.kept_slots(pattern, facts) == [1, 2, 3]


def test_main_text(spark):
    page = "<nav>m</nav><article><h1>A &amp;\n b</h1><p>x<br>y<div class='ad'>buy</div><p>z</p></article><footer>f</footer><script>p</script>"
    df = spark.createDataFrame([(1, "http://h/1", page), (1, "http://h/1", page), (2, "http://h/2", None), (None, None, "<p>q")], "page_id long, url string, html string")
    got = rows(webtext.main_text(df), "page_id", "text", "n_chars")
    assert got == [(1, "A & b\nx y\nz", 11), (1, "A & b\nx y\nz", 11), (2, "", 0), (None, "q", 1)]
    assert webtext.main_text(df.limit(0)).collect() == []


def test_scores(docs, none):
    got = {r.doc_id: r for r in scoring.score(docs, sent_words=20, sent_grams=50).collect()}
    lower = [(t or "").encode().translate(scoring.LOWER_ASCII) for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(TEXTS))]
    known, nodes = Counter(), defaultdict(lambda: [0, 0])
    for i, text in enumerate(lower):
        if held[i]:
            continue
        known.update([*text.split(), None])
        x = b"\xff" * 4 + text + b"\xff"
        for p in range(4, len(x)):
            for depth in range(5):
                for k in range(8):
                    nodes[x[p - depth : p], 1 << k | x[p] >> (8 - k)][x[p] >> (7 - k) & 1] += 1
    below, mixed = defaultdict(float), {}
    own = {key: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for key, (a, b) in nodes.items()}
    for key in sorted(nodes, key=lambda key: -len(key[0])):
        context, node = key
        mixed[key] = own[key] if len(context) == 4 else np.logaddexp(own[key], below[key]) - math.log(2)
        below[context[1:], node] += mixed[key]

    def chance(context, node, bit, depth):
        key = (context[4 - depth :], node)
        a = nodes.get(key, (0, 0))
        mine = (a[bit] + 0.5) / (sum(a) + 1)
        if depth == 4:
            return mine
        w = math.exp(own[key] - math.log(2) - mixed[key]) if key in mixed else 0.5
        return w * mine + (1 - w) * chance(context, node, bit, depth + 1)

    total, distinct = sum(known.values()), len(known)
    for i, text in enumerate(lower):
        tokens = [*text.split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(tokens), total)
        assert r.n_known == sum(known[t] > 0 for t in tokens)
        base = sum(math.log10((known[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        assert r.base_score == pytest.approx(base)
        if len(text) < 300:
            x = b"\xff" * 4 + text + b"\xff"
            code = sum(math.log10(chance(x[p - 4 : p], 1 << k | x[p] >> (8 - k), x[p] >> (7 - k) & 1, 0)) for p in range(4, len(x)) for k in range(8))
            assert r.score == pytest.approx(code, rel=1e-4)
    assert scoring.score(none).collect() == []


def test_token_files(spark, docs, none):
    lib, at = library(queries.BYTE_BPE), 0
    for r in sorted(tokenfile.write_and_read(docs, queries.BYTE_BPE, spark).collect(), key=lambda r: r.doc_id):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    assert tokenfile.write_and_read(none, queries.BYTE_BPE, spark).collect() == []


@pytest.mark.parametrize("values", [[5], [7] * 100, [0, 2**32 - 1], [*range(1000), 2**31, 3]])
def test_blocks(values):
    values = np.array(values, np.uint32)
    for percentile in (0.0, 0.5, 0.9, 1.0):
        assert (tokenfile.unpack_block(tokenfile.pack_block(values, percentile)) == values).all()


def test_file_by_position():
    out = io.BytesIO()
    file = tokenfile.FileWriter(out, 16, 0.9)
    parts = [np.arange(n, dtype=np.uint32) * 7 for n in (0, 5, 40, 16, 1)]
    file.add([1, None, 3, 4, 5], np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])))
    file.close()
    reader = tokenfile.FileReader(pa.BufferReader(out.getvalue()))
    assert reader.doc_ids == [1, None, 3, 4, 5]
    assert all((reader.doc(i) == p).all() for i, p in enumerate(parts))


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(20, 32)] + [(None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    for r in quality.score(docs, labels).collect():
        text = TEXTS[r.doc_id] or ""
        held = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(held[i : i + 5]) for i in range(len(held) - 4))
        covered = {k for i in range(len(held) - 4) if seen[tuple(held[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(held), sum(map(len, held)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(held) < 10 or 100 * len(covered) > 20 * len(held))
        assert not (r.base_failed and r.kept)
    assert quality.score(none, labels.limit(0)).collect() == []


def test_classifier_on_held_out_rows():
    good = [(words(i, 60), 1) for i in range(200)]
    bad = [(" ".join(w + "###" for w in words(1000 + i, 60).split()), 0) for i in range(60)]
    fit = good[:150] + bad[:40]
    model = quality.train([quality.vector(t) for t, _ in fit], [y for _, y in fit])
    assert all((model.probability(t) >= 0.4) == bool(y) for t, y in good[150:] + bad[40:])


def shingles(text, size):
    held = text.encode().translate(neardup.LOWER_ASCII).split()
    size = min(size, len(held))
    return set(zip(*(held[k : len(held) - size + 1 + k] for k in range(size)))) if size else set()


@pytest.mark.parametrize("limit", [3, 16])
def test_near_duplicates(docs, none, limit):
    sets = {i: shingles(t or "", 2) for i, t in enumerate(TEXTS)}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs, limit=limit).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}
    if limit == 3:
        assert neardup.near_duplicates(none).collect() == []


def test_top_k(spark):
    draw = np.random.default_rng(0)
    data = [(i, draw.integers(-9, 9, 6).astype(float).tolist()) for i in range(180)] + [(i, [1.0] * 6) for i in range(180, 210)]
    odd = [(300, None), (350, [1.0, None]), (400, [float("nan")] * 6), (None, [1.0] * 6), (250, [2.0])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=8, range_rows=40, group_rows=2)
    known = {i: [math.floor(256 * x) for x in v] for i, v in [*data, odd[-1]]}
    want = set()
    for q in (i for i in known if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(known[q], known[i])), i) for i in known if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_archives(spark):
    big = "é" * 80
    data = [(3, "u", big), (1, "http://x/\r\ny", big), (2, None, "s"), (5, "u", "s"), (None, "u", big), (9, "u", None), (1, "http://x/\r\ny", big)]
    got = archive.write_and_read(spark.createDataFrame(data, "page_id long, url string, html string").repartition(2), spark)
    found = rows(got, "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, "revisit" if i == 3 else "response", 1 if i == 3 else None, len((t or "").encode()), sha(t)) for i, _, t in data]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert archive.write_and_read(spark.createDataFrame([], "page_id long, url string, html string"), spark).collect() == []


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as out:
        for i in range(66_000):
            out.writestr(f"n{i}", "" if i else "first")
        with out.open("wide", "w", force_zip64=True) as member:
            member.write(b"content")
        out.writestr("packed", b"x" * 99, zipfile.ZIP_DEFLATED)
    index = archive.ZipIndex(raw)
    assert len(index.members) == 66_002 and index.read("n0") == b"first" and index.read("wide") == b"content"
    with pytest.raises(ValueError, match="compressed"):
        index.read("packed")
    with pytest.raises(ValueError, match="not a ZIP"):
        archive.ZipIndex(io.BytesIO(b"nothing"))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        luhn = sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(docs, none):
    for r in pii.digests(pii.spans(docs)).collect():
        text = TEXTS[r.doc_id] or ""
        found = {k: [m.span() for m in re.finditer(p, text) if holds(k, m.group(0))] for k, p in PATTERNS.items()}
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in found[k])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(found[k]) for k in PATTERNS]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert pii.digests(pii.spans(none)).collect() == []
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert got[16].text == "<EMAIL> <IP> <CARD> <PHONE>" and got[16]["_text"] == "clash" and got[0].text is None


def test_no_python_in_personal_data(docs):
    plan = pii.spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_packing(docs, none):
    lib, by_sequence, by_doc = library(queries.BYTE_BPE), defaultdict(list), defaultdict(list)
    cut = packing.written(packing.pieces(docs, queries.BYTE_BPE, capacity=64), "pieces")
    placed, certificates = packing.place(cut, 64, per_group=20)
    for r in placed.collect():
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, text in enumerate(TEXTS):
        ids, at = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 64 or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert all(r.sequences >= r.bound for c in certificates for r in c.collect())
    assert packing.pack(none, queries.BYTE_BPE).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_and_best_fit(seed):
    sizes = np.random.default_rng(seed).integers(1, 65, 60)
    where, offset, held = packing.best_fit(sizes, 64)
    assert held.max() <= 64 and held.sum() == sizes.sum()
    assert packing.lower_bound(sizes, 64) <= len(held)
    assert packing.lower_bound(np.array([40] * 7), 64) == 7
    assert packing.lower_bound(np.array([22] * 6), 64) == 3


def test_pipeline(spark, docs, none, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(20, 25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.drop("_text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    failed = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("NOT kept").collect()}
    left = [i for i in range(len(TEXTS)) if i not in failed]
    sets, parent = {i: shingles(TEXTS[i], 5) for i in left}, {i: i for i in left}
    for a in left:
        for b in (b for b in left if b < a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = {i: min(x, y) if p in (x, y) else p for i, p in parent.items()}
    assert got == {i for i in left if parent[i] == i}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []


def test_json_of_wrappers_round_trips():
    node = webtext.skeleton(webtext.parse("<body><p>a<p>b<table><tr><td>x</table></body>"))
    assert webtext.expression(webtext.Node.unpacked(json.loads(json.dumps(node.packed())))) == webtext.expression(node)


def linked(spark, texts, **settings):
    """Components by the operator and by comparing all pairs."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, **settings).collect()}
    sets = [shingles(t, 2) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return got, {i: find(i) for i in range(len(texts))}


def test_near_duplicates_of_one_template(spark):
    """Texts of one template, alike but not linked, each with one near copy."""
    shared = words(77, 160)
    texts = []
    for i in range(150):
        own = f"{shared} {words(1000 + i, 40)}"
        texts += [own, near(own, i, 2)]
    got, want = linked(spark, texts)
    # Nearly all pairs are linked; a missed link may only split a component.
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(want[c] == want[i] for i, c in got.items())


@pytest.mark.parametrize("levels", [1])
def test_near_duplicates_left_large_are_compared_in_blocks(spark, levels):
    """After one level nearly everything is still together, so blocks have to find the links."""
    shared = words(78, 150)
    texts = [f"{shared} {words(2000 + i // 2, 30 + i % 2)}" for i in range(90)] + [near(shared, i, i % 5) for i in range(60)]
    got, want = linked(spark, texts, limit=4, levels=levels)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_copies_that_only_their_origin_links(spark):
    """Copies of one text, each changed in other places: not linked with each other, all with the text."""
    draw = random.Random(5)
    origin = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(220):
        own = list(origin)
        for at in draw.sample(range(2, 58), 3):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    texts.insert(111, " ".join(origin))
    got, want = linked(spark, texts)
    assert set(want.values()) == {0}
    assert sum(c == 0 for c in got.values()) >= 0.99 * len(texts)


def test_links_are_confirmed_without_a_copy_of_the_texts(spark, monkeypatch):
    """Texts go straight to the groups that compare them, with no table of them written in between."""
    tables = {}
    kept = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, label: tables.setdefault(label, df) and kept(df, label))
    texts = [words(1, 60), near(words(1, 60), 5, 1), words(2, 60), None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (2, 3)], "a long, b long")
    assert [tuple(r) for r in neardup._confirmed(pairs, df, 80, 2).collect()] == [(0, 1)]
    assert not [label for label, held in tables.items() if "text" in held.columns]


def test_near_duplicates_list_no_pairs_of_a_group(spark, monkeypatch):
    """Texts of one template, most of them not linked: what is listed and returned grows with the texts, not with their pairs."""
    tables = []
    kept = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, label: tables.append((label, kept(df, label))) or tables[-1][1])
    shared = words(79, 150)
    texts = [f"{shared} {words(3000 + i, 40)}" for i in range(150)]
    got, want = linked(spark, texts, trees=3)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    listed = sum(held.count() for label, held in tables if label in ("pairs", "links"))
    assert listed <= 6 * len(texts)
