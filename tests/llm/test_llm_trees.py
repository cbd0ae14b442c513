"""Prefix trie, token alignment and page extraction against plain versions."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import llm_cases
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import sitetree
from emberlog.llm.alignment import align_tokens, merge_lanes
from emberlog.llm.dom import parse
from emberlog.llm.forward import SpillingQueue, _passed, subtree_totals
from emberlog.llm.sitetree import composite_importance, extract_articles, style_tree
from emberlog.llm.tokens import byte_characters
from emberlog.llm.trie import ending_hashes, prefix_trie, prefixes, rebuilt

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHES = "id STRING, depth STRING, saved STRING, n STRING, first STRING, _part STRING, extra STRING"

# -- trie ---------------------------------------------------------------------------


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    found = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return found


def plain_trie(sequences):
    nodes = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    found = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        ends = ",".join(map(str, sorted(c for c in members if len(sequences[c]) == len(prefix))))
        childs = {p[: len(p) - 1] for p in nodes if p}
        found.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
            sum(len(p) == len(prefix) + 1 for p in below), sum(p not in childs for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def trie_rows(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-7, 45), 1000, 10**12]:
        for _ in range(rng.choice([0, 1, 2, 5, 9, 12])):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(["user", "bot", None, ""]), rng.choice(["é a", "", None, "b" * 50])))
    rows += [(50, k, "user", f"turn {k}") for k in range(300)] + rows[:5] + [(None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_rebuilt_conversations(spark, seed):
    rows = conversations(seed)
    frame = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], f"conv_id BIGINT, turn BIGINT, role STRING, text STRING, {CLASHES}")
    want = plain_rebuilt(rows)
    assert trie_rows(prefix_trie(rebuilt(frame), frame, shard_nodes=20)) == plain_trie(want)


def test_trie_of_turns_as_they_are(spark):
    rows = conversations(3)
    frame = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").repartition(5)
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    everyone = frame.select("conv_id").unionAll(spark.createDataFrame([(777,)], "conv_id BIGINT"))
    assert trie_rows(prefix_trie(frame, everyone)) == plain_trie({**want, 777: []})
    empty = frame.where("false")
    assert prefix_trie(rebuilt(empty), empty).collect() == []


def test_a_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, k, "r", f"{k}") for c in (1, 2) for k in range(4000)]
        found = prefixes(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_conv = {c: {r["depth"]: (bytes(r["parent"]), bytes(r["id"])) for r in found if r["conv_id"] == c} for c in (1, 2)}
    assert by_conv[1] == by_conv[2] and sorted(by_conv[1]) == list(range(1, 4001))
    assert all(by_conv[1][d][0] == by_conv[1][d - 1][1] for d in range(2, 4001)) and len({i for _, i in by_conv[1].values()}) == 4000


def test_totals_over_a_long_chain_and_a_star(spark):
    chain = [(f"c{k}", f"c{k - 1}" if k else None, k, 1, k) for k in range(400)]
    star = [(f"s{k}", "c0", 1, 2, 1000 + k) for k in range(3000)]
    nodes = spark.createDataFrame(chain + star, "id STRING, parent STRING, depth BIGINT, saved BIGINT, at BIGINT")
    nodes = nodes.withColumns({"id": F.col("id").cast("binary"), "parent": F.col("parent").cast("binary")})
    found = {bytes(r["id"]).decode(): r[1:] for r in subtree_totals(nodes, "at", shard_nodes=150, queue_rows=10).collect()}
    assert found["c0"] == (3001, 3001, 400 + 6000) and found["c7"] == (1, 1, 393) and found["c399"] == (0, 1, 1) and found["s5"] == (0, 1, 2)
    assert len(found) == 3400


def test_spilling_queue_keeps_order():
    rng, queue, held, taken = random.Random(1), SpillingQueue(limit=50), [], []
    for _ in range(5000):
        if rng.random() < 0.6 or not held:
            item = (rng.randrange(1000), rng.randrange(9))
            queue.push(item)
            bisect.insort(held, item)
        else:
            assert queue.peek() == held[0]
            taken.append(queue.pop() == held.pop(0))
    while held:
        taken.append(queue.pop() == held.pop(0))
    assert all(taken) and queue.peek() is None
    assert list(_passed([], 5, True)) == []


def test_hash_of_a_long_list(spark):
    ids = sorted(random.Random(2).sample(range(10**12), 30_000))
    frame = spark.createDataFrame([(b"n", c) for c in ids] + [(b"m", 5)], "id BINARY, conv_id BIGINT").repartition(6)
    found = {bytes(r["id"]): r["ends_sha256"] for r in ending_hashes(frame).collect()}
    assert found == {b"n": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"m": hashlib.sha256(b"5").hexdigest()}


# -- alignment ------------------------------------------------------------------------


def plain_alignment(rows):
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    byte_of = {c: k for k, c in byte_characters().items()}

    def spans(tokens):
        at = 0
        for k, text in tokens:
            yield k, at, at + len(text)
            at += len(text)

    aligned, held = [], Counter()
    for doc, text in rows:
        found = None
        if text:
            left = [(k, bytes(byte_of[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(k, bytes([int(p[1:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k, p in ((k, b.id_to_piece(k)) for k in b.encode(text))]
            if b"".join(t for _, t in left) == (" " + text).encode() == b"".join(t for _, t in right):
                left, right = list(spans(left)), list(spans(right))
                ends = sorted({e for *_, e in left} & {e for *_, e in right})
                group = lambda side, k: ",".join(str(i) for i, _, e in side if bisect.bisect_left(ends, e) == k)
                groups = ";".join(f"{group(left, k)}|{group(right, k)}" for k in range(len(ends)))
                links = [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e]
                held.update(set(links))
                found = (len(left), len(right), len(ends), links, groups)
        aligned.append((doc, found))
    top = Counter()
    for (i, _), count in held.items():
        top[i] = max(top[i], count)
    return [
        (doc, *n[:3], len(n[3]), sum(held[p] == top[p[0]] for p in n[3]), sum(held[p] for p in n[3]), hashlib.sha256(n[4].encode()).hexdigest(), n[4])
        if n else (doc, 0, 0, 0, 0, 0, 0, "", "") for doc, n in aligned
    ]


def alignment_rows(frame):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("cached", [2_000_000, 40, 0])
def test_alignment_of_documents(spark, cached):
    frame = llm_cases.documents(spark).where("length(coalesce(text, '')) < 3000")
    want = plain_alignment([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    assert alignment_rows(align_tokens(frame, BYTES, PIECES, keep_groups=True, cached_pairs=cached)) == sorted(want, key=str)


def test_alignment_of_odd_texts(spark):
    rng = random.Random(11)
    bits = ["a", "The", " ", " ", "  ", "\n", "\t", "\x02", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<s>", "it's", "12", "É", "日本", "▁", " word", "\x00", "́", "<0x41>"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert alignment_rows(align_tokens(frame, BYTES, PIECES, keep_groups=True)) == sorted(plain_alignment(rows), key=str)
    assert align_tokens(llm_cases.none(spark), BYTES, PIECES).collect() == []


def test_lanes_stop_where_they_end():
    a, b, c, d = merge_lanes(np.array([2, 4, 5, 9]), np.array([1, 4, 9]), np.array([0, 2]), np.array([0, 2]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2)]
    assert sorted(zip(c.tolist(), d.tolist())) == [(1, 1), (3, 2)]
    assert all(len(x) == 0 for x in merge_lanes(*[np.zeros(0, np.int64)] * 4))


# -- pages ----------------------------------------------------------------------------


def texts(source):
    return [text for _, text, aside in parse(source).blocks if not aside]


@pytest.mark.parametrize(
    "source, want",
    [
        ("", []),
        ("plain &amp text &lt;b&gt;", ["plain & text <b>"]),
        ("<p>one<p>two <b>bold<br>x</p>three", ["one", "two bold x", "three"]),
        ("<script>var t='</p><p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes", ["yes"]),
        ("<nav>menu</nav><article><header><h1>Head</h1></header><p>text</p><footer>f</footer></article><footer>foot</footer>", ["Head", "text"]),
        ("<div class='sidebar'>s</div><div class='no-sidebar'>kept</div><form>f<p>g</form>tail", ["kept", "tail"]),
        ("<article><p>a</p><section class='comments'><article><p>c</p></article></section></article>", ["a"]),
        ("<div class='comments'><article><p>c</p></article></div><main><article>a</article></main>", ["a"]),
        ("<div class='ad page'><article><p>a</p></article><p>no</p></div>", ["a"]),
        ("<p>a <span class=ad>no</span> b", ["a", "b"]),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", ["x", "y", "1", "2", "3"]),
        ("<p title=\"a > b\">q</p><p title=\"open>r</p>", ["q", "r"]),
        ("a < b <3 </nothing> <p hidden>h</p><p style='display: none'>i", ["a < b <3"]),
        ("<p>a\xa0 \n\tb\x00</p>", ["a b\x00"]),
        ("<div>" * 5000 + "deep", ["deep"]),
        ("<!-- open <p>x", []),
    ],
)
def test_page_blocks(source, want):
    assert texts(source) == want


def shop_pages():
    """A site without helpful markup: a banner text, a changing story, a box of few texts."""
    rng, rows = random.Random(4), []
    for k in range(40):
        story = " ".join(rng.choice("abcdefgh") * 3 for _ in range(30))
        box = ["Buy now", "Sale ends soon"][k % 2]
        html = f"<div class=x1>Welcome to the shop</div><div class=x2><p>{story}</p><p>Read more from us</p></div><div class=x3>{box}</div>"
        rows.append((k, f"http://Shop.example/{k}", html, story))
    return rows


@pytest.mark.parametrize("bound", [500_000, 0])
def test_style_tree_removes_what_a_site_repeats(spark, monkeypatch, bound):
    monkeypatch.setattr(sitetree, "BROADCAST_ROWS", bound)
    rows = shop_pages()
    few = [(100 + k, f"http://few.example/{k}", "<div class=x1>Welcome to the shop</div><p>t</p>", "") for k in range(2)]
    odd = [(200, None, "<p>no site</p>", ""), (201, "http://shop.example/n", None, ""), (None, "nohost", "<p>q</p>", ""), (None, "nohost", "<p>q</p>", "")]
    frame = spark.createDataFrame([(*r[:3], "x", "x", "x") for r in rows + few + odd], "page_id BIGINT, url STRING, html STRING, text STRING, blocks STRING, _host STRING")
    found = extract_articles(frame).collect()
    by_id = defaultdict(list)
    for r in found:
        assert r["n_chars"] == len(r["text"])
        by_id[r["page_id"]].append(r["text"])
    assert len(found) == 46 and by_id[None] == ["q", "q"]
    assert {k: by_id[k] for k, *_ in rows} == {k: [story] for k, _, _, story in rows}
    assert by_id[100] == ["Welcome to the shop\nt"] and by_id[200] == ["no site"] and by_id[201] == [""]
    assert extract_articles(frame.where("false")).collect() == []


def test_importance_against_a_plain_recursion(spark):
    pages = [parse(r[2]) for r in shop_pages()]
    shapes, styles, said = {}, defaultdict(Counter), defaultdict(Counter)
    for page in pages:
        for branch, (parent, depth, style, article) in page.shapes.items():
            shapes[branch] = parent
            styles[branch][style] += 1
        for chain in {tuple(chain[-2:]) for chain, _, _ in page.blocks}:
            said[chain[0]][chain[1]] += 1
    pages_of = {b: sum(c.values()) for b, c in styles.items()}

    def importance(branch):
        m = pages_of[branch]
        own = 1.0 if m == 1 else -sum(k / m * np.log(k / m) for k in styles[branch].values()) / np.log(m)
        parts = [(pages_of[c], importance(c)) for c, p in shapes.items() if p == branch]
        if said[branch]:
            parts.append((m, np.mean([1 - (np.log(k) / np.log(m) if m > 1 else 0) for k in said[branch].values()])))
        if not parts:
            return own
        share = 0.9 ** len(styles[branch])
        return (1 - share) * own + share * sum(w * x for w, x in parts) / sum(w for w, _ in parts)

    rows = [("h", [{"chain": c, "text": t, "aside": a} for c, t, a in p.blocks], [(b, *s) for b, s in p.shapes.items()]) for p in pages]
    parsed = spark.createDataFrame(rows, f"_host string, blocks array<{sitetree._BLOCK}>, shapes array<{sitetree._SHAPE}>")
    found = {r["branch"]: r["importance"] for r in composite_importance(style_tree(parsed)[0]).collect()}
    assert found.keys() == shapes.keys()
    assert all(abs(found[b] - importance(b)) < 1e-9 for b in found)
