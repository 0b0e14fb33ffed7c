"""Chat formatting, spelling variants and the conversation trie against direct computations."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from quillwave.llm import chat, queries, spelling, sql, trie
from quillwave.llm.chat import INSTRUCTION, Located, Template

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, piece long, pos long"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def table():
    """Ties, nulls, repeated rows, equal prefixes, one long conversation, and clashing extra columns."""
    draw = random.Random(3)
    out = []
    for c in range(40):
        for turn in range(draw.randint(1, 9)):
            text = draw.choice(["hi", "<s>", "a [INST] b", "<\\s> x", "é😀", "long " * 50, ""])
            out.append((c, turn, ["user", "assistant", "system", "odd\nrole</s>"][draw.randrange(4)], text))
    out += [(50, None, "user", "first"), (50, 3, None, "x"), (50, 3, "user", None), (50, 3, "user", "tie"), (50, 3, "user", "tie")]
    out += [(55, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(700)]
    out += [(56, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(256)]
    out += [(57, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(130)]
    out += [(None, 1, "user", "nobody"), (None, 0, "assistant", "no one")]
    return out


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in table()], SCHEMA).repartition(6).cache()


@pytest.fixture(scope="module")
def held():
    out = defaultdict(list)
    for c, turn, role, text in table():
        out[c].append(((turn is not None, turn or 0), digest(role or "", text or ""), role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


# --- chat -----------------------------------------------------------------


def read_digests(held):
    for c, turns in held.items():
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = INSTRUCTION.render([(INSTRUCTION.escape(r), INSTRUCTION.escape(t)) for r, t in turns])
        yield (c, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))


@pytest.mark.parametrize("most", [64, 5, 1000])
def test_read_back(talks, held, most):
    got = {r.conv_id: tuple(r) for r in chat.read_back(talks, most=most).collect()}
    assert got == {row[0]: row for row in read_digests(held)}


def test_pieces_join_to_the_whole(talks, held):
    """A template whose text for a turn depends on the turn before."""

    def render(turns):
        out = ["{"]
        for before, (role, text) in zip([("", "")] + turns, turns):
            out.append(f"<{role if role != before[0] else '='}|{len(before[1])}>{text}<.>")
        return "".join(out) + "}"

    template = Template(render, lambda marks: "", ("<.>", "<s>"), closing="}", lookback=1)
    whole, cut = chat.pieces(talks, 16, 1)
    out = defaultdict(list)
    for r in chat.formatted(whole.unionByName(cut), template).collect():
        assert r.rewrote_at is None
        out[r.conv_id].append((r.piece, r.formatted, r.spans))
    for c, turns in held.items():
        escaped = [(template.escape(r), template.escape(t)) for r, t in turns]
        parts = sorted(out[c], key=lambda p: p[0])
        assert "".join(p[1] for p in parts) == render(escaped)
        texts = [p[1][s.text_begin : s.text_end] for p in parts for s in p[2]]
        assert texts == [t for _, t in escaped]
        assert all(a.end == b.begin for p in parts for a, b in zip(p[2], p[2][1:]))


def test_templates_that_rewrite_history(talks, held):
    def short_past(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t[:1]}" for i, (r, t) in enumerate(turns))

    def moved_system(turns):
        first = [t for r, t in turns if r == "system"]
        return "".join(f"({t})" for t in first) + "".join(f"[{r}]{t}" for r, t in turns if r != "system")

    for render in (short_past, moved_system):
        template = Template(render, lambda marks: marks[1:-1], ("<s>",))
        got = {r.conv_id: r for r in chat.format_conversations(talks, template, most=2000).collect()}
        found = 0
        for c, turns in held.items():
            outs = [render([(template.escape(r), template.escape(t)) for r, t in turns[:k]]) for k in range(1, len(turns) + 1)]
            first = next((k for k in range(1, len(outs)) if not outs[k].startswith(outs[k - 1])), None)
            assert got[c].rewrote_at == first and got[c].formatted == outs[-1]
            assert first is None or got[c].spans == []
            found += first is not None
        assert found


def test_text_changed_by_the_template():
    template = Template(lambda turns: "".join(f"[{r}]{t.strip()};" for r, t in turns), lambda m: m[1:-1], ("<s>",))
    text, spans, rewrote = Located(template)([], [("user", "a"), ("user", " b ")], True)
    assert text == "[user]a;[user]b;" and rewrote is None
    assert spans == [(0, 6, 7, 8), (8, -1, -1, 16)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*INSTRUCTION.controls, "<", "[", "\\", "\\\\", "s>", "/INST]", "a", "]", "\n"])).map("".join))
def test_escape_is_reversible(text):
    escaped = INSTRUCTION.escape(text)
    assert INSTRUCTION.unescape(escaped) == text
    assert not any(c in escaped for c in INSTRUCTION.controls)


def test_overlapping_controls_are_refused():
    for controls in (("<s>", "a<s>b"), ("ab", "bc"), ("x",), ("a\\b",)):
        with pytest.raises(ValueError):
            Template(str, str, controls)


def test_chat_empty(talks):
    assert chat.read_back(talks.limit(0)).collect() == []


# --- spelling ---------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) == 1:
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def test_spelling(spark):
    draw = random.Random(1)
    base = ["".join(draw.choice("abcé") for _ in range(draw.randint(7, 9))) for _ in range(40)]
    base += ["colours", "colour", "coloured", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababa", "bababab", "Straße×ß", "naïvetés"]
    texts = []
    for i in range(300):
        some = [w for w in draw.choices(base, k=6)]
        some += [w[:k] + draw.choice("abcx") + w[k + 1 :] for w in some for k in [draw.randrange(len(w))] if draw.random() < 0.4]
        some += [w.upper() if draw.random() < 0.3 else w + draw.choice("ab1,") for w in some[:2]]
        texts.append((i, " ".join(some)))
    texts += [(None, "colourful colourful"), (400, None), (401, ""), (402, "x" * 30_000), (402, "x" * 30_000)] + texts[:40]
    df = spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, n long").repartition(5)
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    n = {w: c for w, c in counts.items() if c >= 2 and len(w) >= 7}
    found = {w: sorted((v for v in n if v != w and near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: f[0] if f and n[f[0]] >= 10 * n[w] else None for w, f in found.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    want = {w: (form[w], root(w), n[w], len(found[w]), n[form[w]] if form[w] else None) for w in n}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    assert got == want
    assert sum(len(f) for f in found.values()) > 50 and any(form.values())
    assert spelling.variants(df.limit(0)).collect() == []


def test_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w3")], "word string, form string")
    assert set(rows(spelling.last_of_chain(forms))) == {(f"w{i}", "w11") for i in range(11)} | {("a", "w11")}


# --- trie -------------------------------------------------------------------


def direct_trie(paths):
    """Nodes of {conv_id: [(role, text)]} by listing all prefixes."""
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        yield (own[0], len(node), parent, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())


def rebuilt(held):
    own = {c: turns for c, turns in held.items() if c is not None}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("per_shard,per_block", [(2048, 128), (7, 3), (1, 256)])
def test_trie(talks, held, per_shard, per_block):
    got = sorted(map(tuple, trie.trie(*trie.rebuilt(talks), per_shard, per_block).collect()), key=str)
    assert got == sorted(direct_trie(rebuilt(held)), key=str)


def test_trie_empty_and_turnless(spark, talks):
    assert trie.trie(*trie.rebuilt(talks.limit(0))).collect() == []
    # Conversation 1 has fewer turns than it would skip, and there is no conversation 0.
    assert zlib.crc32(b"1") % 9 > 1
    one = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    ends = hashlib.sha256(b"1").hexdigest()
    assert rows(trie.trie(*trie.rebuilt(one))) == [(1, 0, None, 1, 0, 1, 0, ends)]


def test_equal_copies_share_one_path(spark):
    data = [(c, t, "user", f"t{t}") for c in range(0, 200, 5) for t in range(20)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    paths = {c: [("user", f"t{t}") for t in range(20)] for c in range(0, 200, 5)}
    assert sorted(map(tuple, trie.trie(*trie.rebuilt(df), 16, 6).collect()), key=str) == sorted(direct_trie(paths), key=str)


# --- SQL ----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_incremental_chat", "op12_partenum_spelling", "op13_bitmap_prefix_trie"])
def test_queries_equal_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("conversations", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    mine = queries.QUERIES[name](spark, small)
    theirs = duck.sql(queries.ORACLES[name])
    assert sorted(theirs.columns) == sorted(mine.columns)
    listed = ", ".join(mine.columns)
    assert rows(mine) == sorted(duck.sql(f"SELECT {listed} FROM ({queries.ORACLES[name]})").fetchall(), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_crc32_sql():
    for text in ("", "a", "12:naïveté", "😀" * 9):
        assert duckdb.execute(f"SELECT {sql.crc32('t')} FROM (SELECT ? AS t)", [text]).fetchone()[0] == zlib.crc32(text.encode())
