"""Operators on documents against plain versions of the same definitions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import llm_cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from emberlog.llm import lines
from emberlog.llm import lm
from emberlog.llm.common import Shared
from emberlog.llm.ctw import ContextTree, counted, decisions, gram_codes, log_kt, prepared
from emberlog.llm.decontaminate import WuManber, find_benchmark, hit_words, words
from emberlog.llm.lines import dedup_lines
from emberlog.llm.lm import score_texts
from emberlog.llm.neardup import BANDS, ROWS, estimated_jaccard, near_duplicates, registers
from emberlog.llm.packing import cut, hilbert_keys, pack_documents
from emberlog.llm.quality import score_quality, train_quality, with_statistics
from emberlog.llm.tokenfiles import TokenFileReader, read_token_files, write_token_files
from emberlog.llm.tokens import Encoder
from emberlog.session import scratch_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LED, DROPPED = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def documents(spark):
    return llm_cases.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


def tokens(path, text, end):
    tokenizer = Tokenizer.from_file(path)
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


# -- benchmark ----------------------------------------------------------------


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_hits(text, items):
    found = plain_words(text)
    hit, who = set(), set()
    for item, body in items:
        own = plain_words(body)
        size = min(10, len(own))
        for s in range(len(own) - size + 1 if own else 0):
            for at in range(len(found) - size + 1):
                if found[at : at + size] == own[s : s + size]:
                    hit |= set(range(at, at + size))
                    who.add(item)
    return len(found), len(hit), sorted(who)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_benchmark(spark, documents, rows, block_bytes):
    base = llm_cases.texts()[6]
    items = [(1, " ".join(base.split(" ")[5:30])), (2, "three LITTLE words!"), (3, None), (4, ""), (5, "one"), (5, "日本語"), (11, base.split(" ")[3] * 1)]
    benchmark = spark.createDataFrame([*items, (None, "one")], "item_id BIGINT, text STRING")
    found = find_benchmark(documents, benchmark, block_bytes=block_bytes)
    assert found.columns[:2] == ["doc_id", "text"] and found.columns.count("n_words") == 1
    got = [(r["doc_id"], r["text"], r["n_words"], r["hit"], r["item_ids"]) for r in found.withColumn("hit", hit_words("spans")).collect()]
    assert sorted(got, key=repr) == sorted([(d, t, *plain_hits(t, items)) for d, t in rows], key=repr)


def test_benchmark_empty(spark, documents):
    none = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert {tuple(r) for r in find_benchmark(documents, none).select(F.size("spans"), F.size("item_ids")).collect()} == {(0, 0)}
    assert find_benchmark(llm_cases.none(spark), none).count() == 0


def test_wu_manber_against_scan():
    rng = np.random.default_rng(1)
    for length in (1, 2, 5, 10):
        text = rng.integers(0, 3, 400).tolist()
        patterns = {tuple(rng.integers(0, 3, length).tolist()): {k} for k in range(20)}
        patterns[tuple(text[50 : 50 + length])] = {99}
        found = sorted((at, min(items)) for at, items in WuManber(length, patterns).search(text))
        assert found == [(k, min(patterns[p])) for k in range(400 - length + 1) if (p := tuple(text[k : k + length])) in patterns]


# -- near copies ---------------------------------------------------------------


def plain_components(sets, linked):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                parent[root(a)] = root(b)
    return [root(x) for x in range(len(sets))]


def plain_shingles(text):
    found = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    size = min(4, len(found))
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} if found else set()


def test_near_duplicates(spark, documents, rows):
    sets = [plain_shingles(t) for _, t in rows]
    roots = plain_components(sets, lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b))
    least = defaultdict(list)
    for (doc, _), root in zip(rows, roots):
        if doc is not None:
            least[root].append(doc)
    expected = [(d, len(s), None if d is None else min(least[r]), d is not None and d == min(least[r])) for (d, _), s, r in zip(rows, sets, roots)]
    got = [tuple(r) for r in near_duplicates(documents).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert near_duplicates(llm_cases.none(spark)).count() == 0


def test_near_duplicates_in_blocks(spark, documents, rows, monkeypatch):
    whole = sorted(map(tuple, near_duplicates(documents).collect()), key=repr)
    monkeypatch.setattr("emberlog.llm.neardup.BLOCK_SHINGLES", 60)
    assert sorted(map(tuple, near_duplicates(documents).collect()), key=repr) == whole


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for size, shared in ((2000, 0.8), (300, 0.8), (40, 0.5), (2000, 0.0)):
        errors = []
        for _ in range(12):
            pool = rng.integers(0, 1 << 63, 2 * size).astype(np.uint64)
            common = int(size * 2 * shared / (1 + shared))
            a, b = np.unique(pool[:size]), np.unique(pool[size - common : 2 * size - common])
            equal = np.array([(registers(a) == registers(b)).mean()])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(estimated_jaccard(equal, np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 3 / math.sqrt(BANDS * ROWS) + 0.03


def test_near_duplicates_of_short_texts(spark):
    """Texts of 7 to 10 words and the same with one word more: each pair is linked, at J 0.8 to 0.875."""
    rows = []
    for k in range(1500):
        text = " ".join(f"w{k}x{j}" for j in range(7 + k % 4))
        rows += [(2 * k, text), (2 * k + 1, f"{text} more")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert [r[0] for r in found.where("component_id <> doc_id - doc_id % 2").select("doc_id").collect()] == []


# -- lines ------------------------------------------------------------------------


def plain_lines(rows):
    def shingles(line):
        return {line[i : i + 9] for i in range(max(len(line) - 8, 1))}

    order = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    places = [(last, d, t, p, line) for last, d, t in order for p, line in enumerate(t.split("\n")) if line.strip(" ")]
    distinct = sorted({p[-1] for p in places})
    sets = [shingles(line) for line in distinct]
    component = dict(zip(distinct, plain_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))))
    seen, drop = set(), defaultdict(set)
    for last, d, t, p, line in places:
        if component[line] in seen:
            drop[(last, d, t)].add(p)
        seen.add(component[line])
    out = []
    for d, t in rows:
        gone = drop[(d is None, d or 0, t)]
        kept = None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if p not in gone)
        out.append((d, kept, sum(bool(line.strip(" ")) for line in (t or "").split("\n")), len(gone)))
    return out


def test_lines(spark, documents, rows):
    # Rows of one id and different hashes are ordered by hash; here no two texts share an id.
    found = dedup_lines(documents)
    assert found.columns == [*documents.columns, "n_lines", "n_dropped"]
    got = [tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == sorted(plain_lines(rows), key=repr)
    assert sum(r[3] for r in got) > 3
    assert dedup_lines(llm_cases.none(spark)).count() == 0


def test_lines_of_large_buckets(spark):
    """400 lines of one template, below 0.8 to each other, and a copy of each with one small change."""
    rng = np.random.default_rng(2)
    frame = "all rights reserved by the owner of these pages see the terms of use and ask"
    rows = []
    for k in range(400):
        own = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(8))
        rows += [(2 * k, f"{frame} {own}"), (2 * k + 1, f"{frame} {own} q")]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert [r[0] for r in found.where("n_dropped <> doc_id % 2").collect()] == []


def test_lines_without_spaces(spark):
    """Lines that begin alike and have no spaces stay; one long line and the same with a changed end are copies."""
    alike = ["https://www.a.org/x", "https://wiki.b.net/y", "2026-07-20T00:00:01Z", "2026-07-20T11:59:59.25Z", "日本語のテキストです。これは一つ目。", "日本語のテキストです。別の話になる。"]
    long = "https://www.a.org/" + "".join(chr(97 + k * k % 26) + str(k) for k in range(60))
    rows = [(k, line) for k, line in enumerate([*alike, long, f"{long}z", "𝒳𝒴 short", "𝒳𝒴 shor"])]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert [r[0] for r in found.where("n_dropped > 0").collect()] == [7]


def test_near_copies_of_many_lines(spark):
    """Lines of all lengths, with and without spaces, each with copies changed at random places."""
    rng = random.Random(9)
    rows = []
    for k in range(500):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 60))]
        line = rng.choice([" ", " ", " ", "", "日"]).join(words)
        for _ in range(rng.randrange(1, 4)):
            rows.append((len(rows), line))
            at = rng.randrange(len(line) + 1)
            line = line[:at] + rng.choice(["", "x", " yy", "zzz "]) + line[at + rng.randrange(3) :]
    rng.shuffle(rows)
    found = dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    got = sorted(tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect())
    want = sorted(plain_lines(rows))
    assert sum(r[3] for r in want) > 200 and got == want


def test_a_bucket_of_several_groups(spark):
    """Hundreds of near copies of one line, and of another that shares most of its bands."""
    rng = random.Random(4)
    base = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(1000)}" for _ in range(80))
    half = base[: len(base) // 2] + " ".join(f"z{rng.randrange(1000)}" for _ in range(40))
    rows = []
    for k in range(600):
        line = (base, half)[k % 2]
        at = rng.randrange(len(line) - 5)
        rows.append((k, line[:at] + f"#{k}" + line[at + 2 :]))
    found = dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert sorted(r[0] for r in found.where("n_dropped = 0").collect()) == [0, 1]


def _random_words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randrange(4, 9))) for _ in range(n)]


def test_lines_around_a_common_passage_make_few_pairs(spark, monkeypatch):
    """Lines that hold one passage share bands, and are not similar."""
    rng, made = random.Random(5), {}
    passage = _random_words(rng, 70)
    texts = [" ".join(_random_words(rng, 30) + passage + _random_words(rng, 30)) for _ in range(80)]

    def counted(frame, purpose, f=lines.stored):
        made.setdefault(purpose, []).append(f(frame, purpose))
        return made[purpose][-1]

    monkeypatch.setattr(lines, "stored", counted)
    frame = spark.createDataFrame(list(enumerate([*texts, texts[0] + " end"])), "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(frame).collect()} == dict.fromkeys(range(80), 0) | {80: 1}
    assert sum(f.count() for f in made["more-pairs"]) <= 80


def test_lines_beside_a_large_group_make_few_pairs(spark, monkeypatch):
    """Lines that hold most of what a group of near copies holds, and are not similar to any of it."""
    rng, made = random.Random(11), {}
    passage = _random_words(rng, 70)
    group = [" ".join([*passage[:k], *_random_words(rng, 1), *passage[k + 1 :]]) for k in range(5, 65)]
    beside = [" ".join(passage + _random_words(rng, 17)) for _ in group]

    def counted(frame, purpose, f=lines.stored):
        made.setdefault(purpose, []).append(f(frame, purpose))
        return made[purpose][-1]

    monkeypatch.setattr(lines, "DIRECT", 20)
    monkeypatch.setattr(lines, "stored", counted)
    rows = list(enumerate([*group, *beside, beside[-1] + " end"]))
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()) == sorted(plain_lines(rows))
    assert sum(f.count() for f in made["more-pairs"]) <= len(group)


def test_shared_shingles_give_every_similar_pair(spark):
    """Every similar pair of different components, whatever the lines' lengths and common parts."""
    rng, frame = random.Random(12), _random_words(random.Random(13), 30)
    texts = []
    for _ in range(120):
        line = [*frame[: rng.randrange(31)], *_random_words(rng, rng.randrange(8))]
        texts += [" ".join(line), " ".join(line[:-1]), " ".join(line + _random_words(rng, 1))]
    texts = sorted({t for t in texts if t})
    sets = [{t[i : i + 9] for i in range(max(len(t) - 8, 1))} for t in texts]
    similar = {(a, b) for b in range(len(texts)) for a in range(b) if a % 40 != b % 40 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    held = spark.createDataFrame(list(enumerate(texts)), "line bigint, _line string")
    inside = held.select("line", (F.col("line") % 40).alias("component"))
    got = set(map(tuple, lines._sharing(inside, held, lines.line_profiles(held), 80).collect()))
    assert similar <= got and len(similar) > 100 and len(got) < 2 * len(similar)


def test_shingles_in_parts_give_every_similar_pair(spark, monkeypatch):
    """Strays of many shingles beside the corpus meet part by part, each with few of the shingles."""
    rng, made = random.Random(14), {}
    texts = []
    for _ in range(100):
        line = _random_words(rng, rng.randrange(1, 40))
        texts += [" ".join(line), " ".join(line[:-1] + _random_words(rng, 1)), " ".join(line + _random_words(rng, 1))]
    texts = sorted(set(texts))
    sets = [{t[i : i + 9] for i in range(max(len(t) - 8, 1))} for t in texts]
    similar = {(a, b) for b in range(len(texts)) for a in range(b) if a % 40 != b % 40 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}

    def counted(frame, purpose, f=lines.stored):
        made.setdefault(purpose, []).append(f(frame, purpose))
        return made[purpose][-1]

    monkeypatch.setattr(lines, "stored", counted)
    for name, value in (("CHARS_PER_GRAM", 6), ("PART_GRAMS", 1), ("LINE_GRAMS", 4)):
        monkeypatch.setattr(lines, name, value)
    held = spark.createDataFrame(list(enumerate(texts)), "line bigint, _line string")
    inside = held.select("line", (F.col("line") % 40).alias("component"))
    found = lines._sharing(inside, held, lines.line_profiles(held), 80, held.withColumnRenamed("_line", "_text"))
    assert similar <= set(map(tuple, found.collect())) and len(similar) > 50
    assert len(made["first-grams"]) in (6, 7)
    grams = [{r["band"] for r in f.select("band").distinct().collect()} for f in made["first-grams"]]
    assert all(grams) and sum(map(len, grams)) == len(set().union(*grams))


def test_shuffle_files_go_with_the_write(spark):
    """Nothing is left of the shuffles of a stored frame, and the session's own setting is as before."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())}
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    assert spark.conf.get(key) == "false"
    held = spark.range(100_000).groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n"))
    kept = lines.stored(held.groupBy((F.col("h") % 1000).alias("h")).agg(F.sum("n").alias("n")), "shuffled")
    for _ in range(50):
        if not {f for f in files() - before if f.startswith("shuffle_")}:
            break
        time.sleep(0.2)
    assert not {f for f in files() - before if f.startswith("shuffle_")}
    assert kept.agg(F.sum("n")).first()[0] == 100_000 and spark.conf.get(key) == "false"


@pytest.mark.parametrize("direct", [2, 1000])
def test_crowded_bands_give_every_pair_of_like_sketches(spark, monkeypatch, direct):
    """Each pair of sketches with enough equal parts, whether its band is made longer or not."""
    monkeypatch.setattr(lines, "DIRECT", direct)
    rng, own = random.Random(6), 5
    parts = [[rng.randrange(2) for _ in range(16)] for _ in range(60)]
    for p in parts:
        p[2 * own : 2 * own + 2] = 3, 4
    signed = lambda p: int.from_bytes(sum(x << 4 * i for i, x in enumerate(p)).to_bytes(8, "little"), "little", signed=True)
    rows = spark.createDataFrame([(1600 + own, n, signed(p)) for n, p in enumerate(parts)], "band bigint, line bigint, sig bigint")
    found = spark.createDataFrame([(n, 0) for n in range(10)], "node bigint, component bigint")
    profiles = lines.line_profiles(spark.createDataFrame([], "line bigint, _line string"))
    got = sorted(map(tuple, lines._strays(rows, found, profiles, 80).collect()))
    alike = [(a, b) for b in range(60) for a in range(b) if b >= 10 and sum(x == y for x, y in zip(parts[a], parts[b])) >= lines.AGREEING_LONGER]
    assert got == sorted(alike) and alike


def test_profiles_rule_out_no_similar_pair(spark):
    rng = random.Random(7)
    words = _random_words(rng, 60)
    near = [" ".join(words[:k] + _random_words(rng, 60 - k)) for k in range(30, 61)]
    texts = spark.createDataFrame(list(enumerate([*near, "short", "ab " * 300, "ab " * 290 + "cd"])), "line bigint, _line string")
    pairs = texts.select(F.col("line").alias("a")).crossJoin(texts.select(F.col("line").alias("b"))).where("a < b")
    plain = set(map(tuple, lines.linked(pairs, texts, 80).collect()))
    assert set(map(tuple, lines.linked(pairs, texts, 80, lines.line_profiles(texts)).collect())) == plain and len(plain) > 10


def test_near_copies_of_a_line_that_repeats_a_word(spark):
    rng = random.Random(8)
    texts = [f"{' '.join([w] * 3000)} {' '.join(tail)}" for w in _random_words(rng, 6) for tail in [_random_words(rng, 12)]]
    frame = spark.createDataFrame(list(enumerate([*texts, *[t + " ab" for t in texts]])), "doc_id bigint, text string")
    source = frame.select(F.col("doc_id").alias("_doc"), F.col("doc_id").alias("_row"), F.col("text").alias("_text"))
    assert lines.line_sketches(source).where("sig <> 0").count() == 12
    assert {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(frame).collect()} == {n: int(n >= 6) for n in range(12)}


def test_lines_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(lines, "LONG_CHARS", 700)
    rng = random.Random(6)
    spaced = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900))
    solid = "".join(rng.choice("abcdefghijkl") for _ in range(3000))
    rows = [(0, spaced), (1, f"{spaced[:3000]}changed{spaced[3100:]}"), (2, spaced[:4000]), (3, solid), (4, solid + "end"), (5, solid[:1500]), (6, spaced)]
    rows += [(7, solid[:703]), (8, solid[:700])]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert sorted(tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()) == sorted(plain_lines(rows))


def test_very_long_lines(spark):
    rng = random.Random(8)
    solid = "".join(rng.choice("abcdefghijkl") for _ in range(3_000_000))
    words = " ".join(solid[k : k + 7] for k in range(0, 2_000_000, 7))
    rows = [(0, solid), (1, solid + "q"), (2, words), (3, words[:-5]), (4, "x" * 3_000_000)]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert sorted(r[0] for r in found.where("n_dropped = 1").collect()) == [1, 3]


# -- tokens -------------------------------------------------------------------------


@pytest.mark.parametrize("special", [True, False])
@pytest.mark.parametrize("path,cut_at", [(LED, "led"), (DROPPED, "dropped")])
def test_encoder_equals_the_library_on_odd_texts(path, cut_at, special):
    """Special tokens, the encoder's own head mark, kinds of white space and marks, in any order."""
    rng = random.Random(7)
    bits = ["a", "The", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\x02", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>", "<|endo", "don't", "'s",
            "123", "\u00c9", "\u65e5\u672c", "x", "!!", "<", "|>", "Word", " word", "\x00", "\u0301", "\u00df", "\u0130"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(8000)] + ["a \x02b", "say <|endoftext|> now"]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(path, cut_at, special).encode(pa.array(texts, pa.large_string())) == want


@pytest.mark.parametrize("path,cut_at", [(LED, "led"), (DROPPED, "dropped"), (LED, "whole")])
def test_encoder_equals_whole_texts(path, cut_at):
    texts = [t or "" for t in llm_cases.texts()]
    assert Encoder(path, cut_at).encode(pa.array(texts, pa.large_string())) == [tokens(path, t, 0)[:-4] for t in texts]


def test_encoder_of_another_tokenizer():
    texts = [t or "" for t in llm_cases.texts()]
    encoder = Encoder(DROPPED, "led")  # its probes disagree, so the tokenizer's own patterns are used
    assert encoder.split is None and Encoder(LED, "led").split is not None


def test_token_files(spark, documents, rows, monkeypatch):
    monkeypatch.setattr("emberlog.llm.tokenfiles.FRAME_TOKENS", 200)
    monkeypatch.setattr("emberlog.llm.tokenfiles.FRAMES_PER_TASK", 2)
    files = write_token_files(documents, scratch_dir(spark, "files"), DROPPED, end_id=2)
    got = sorted(map(tuple, read_token_files(files).collect()), key=lambda r: r[1])
    assert sorted(((d, bytes(i)) for d, _, i in got), key=repr) == sorted(((d, tokens(DROPPED, t, 2)) for d, t in rows), key=repr)
    assert [d for d, _, _ in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [s for _, s, _ in got] == [0, *np.cumsum([len(i) // 4 for _, _, i in got])[:-1]]
    path = files.orderBy("part").first()["path"].removeprefix("file://")
    data = open(path, "rb")
    reader = TokenFileReader(data, data.seek(0, 2))
    assert len(reader.sizes) > 2
    read = []
    monkeypatch.setattr(reader, "frame", lambda k, f=reader.frame: read.append(k) or f(k))
    wanted = got[3][0]
    assert {d for d, _ in reader.documents({wanted})} == {wanted} and len(read) < len(reader.sizes)
    empty = write_token_files(llm_cases.none(spark), scratch_dir(spark, "files"), DROPPED, end_id=2)
    assert empty.count() == 0 and read_token_files(empty).count() == 0


def test_damaged_token_file(spark, documents, tmp_path):
    files = write_token_files(documents.limit(5), str(tmp_path), DROPPED, end_id=2)
    path = files.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[-9 - 12 + 8] ^= 1  # the checksum of the last frame
    open(path, "wb").write(data)
    source = open(path, "rb")
    reader = TokenFileReader(source, len(data))
    with pytest.raises(ValueError, match="damaged"):
        list(reader.frame(len(reader.sizes) - 1))


def test_packing(spark, documents, rows):
    got = pack_documents(documents, LED, size=128).collect()
    expected = Counter((d, tokens(LED, t, 1)) for d, t in rows)
    assert sum(len(r["ids"]) for r in got) == sum(len(i) * n for (_, i), n in expected.items())
    by_sequence, by_document = defaultdict(list), defaultdict(Counter)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], len(r["ids"]) // 4))
        by_document[r["doc_id"]][(r["start"], bytes(r["ids"]), r["doc_tokens"])] += 1
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 128 or at & (at - 1) == 0
    for (doc, ids), times in expected.items():
        if times == 1:
            joined = b"".join(i for _, i, _ in sorted(by_document[doc]))
            assert joined == ids and {t for _, _, t in by_document[doc]} == {len(ids) // 4}
    assert pack_documents(llm_cases.none(spark), LED).count() == 0


def test_cut_of_exact_and_small_streams():
    assert [(d, s, len(i) // 4, q, o) for d, s, i, _, q, o in cut(iter([(1, b"abcd" * 8)]), 8)] == [(1, 0, 8, 0, 0)]
    assert [(d, s, len(i) // 4, q, o) for d, s, i, _, q, o in cut(iter([(1, b"abcd" * 2), (2, b"abcd" * 5)]), 8)] == [
        (1, 0, 2, 0, 0), (2, 0, 2, 0, 2), (2, 2, 2, 1, 0), (2, 4, 1, 2, 0),
    ]
    assert list(cut(iter([]), 8)) == []


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# -- quality ----------------------------------------------------------------------------


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train_quality(documents, labels)
    assert 1 <= len(model.rules) <= 200
    held = score_quality(documents, model).join(labels, "doc_id").where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0")
    right = held.select(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] > 50


def plain_statistics(text):
    text = text or ""
    words, lines_ = re.split(r"[ \t-\r]+", text.strip(" ")), text.split("\n")
    chars, count = max(len(text), 1), max(len(words), 1)
    found = {
        "chars": math.log1p(len(text)), "words": math.log1p(len(words)), "lines": math.log1p(len(lines_)), "word_chars": len(text) / count,
        "line_chars": math.log1p(len(text) / len(lines_)),
        "distinct_words": len(set(words)) / count, "distinct_lines": len(set(lines_)) / len(lines_),
        "repeated_words": sum(a == b for a, b in zip(words, words[1:])) / count,
    }
    classes = {"upper": r"\p{Lu}", "digits": r"\p{N}", "symbols": r"[^\p{L}\p{N} \t-\r]"}
    found |= {name: len(regex.findall(pattern, text)) / chars for name, pattern in classes.items()}
    runs = {"symbol_runs": r"[^\p{L}\p{N} \t-\r]{2,}", "lone_symbols": r"(?<=[ \t-\r])[^\p{L}\p{N} \t-\r]+(?=[ \t-\r])"}
    return found | {name: len(regex.findall(pattern, text)) / count for name, pattern in runs.items()}


def test_quality_columns_against_rules_held_in_numpy(spark, documents, rows):
    """Statistics, rules and scores of the compiled columns equal those of plain code."""
    tables = [spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels")]
    model = train_quality(*tables)
    assert model.rules
    every = rows + [(r["doc_id"], r["text"]) for r in tables[0].collect()]
    frame = spark.createDataFrame(list(enumerate(t for _, t in every)), "doc_id BIGINT, text STRING")
    names = [f"_s_{n}" for n in plain_statistics("")]
    values = np.array([list(plain_statistics(t).values()) for _, t in every])
    got = {r["doc_id"]: r for r in with_statistics(frame, "text")[0].collect()}
    assert np.allclose([[got[k][n] for n in names] for k in range(len(every))], values, rtol=1e-12)
    total = model.intercept + sum(weight * rule.holds(values, names) for rule, weight in model.rules)
    scored = {r["doc_id"]: r for r in score_quality(frame, model).collect()}
    assert np.allclose([scored[k]["score"] for k in range(len(every))], 1 / (1 + np.exp(-total)), rtol=1e-9)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in scored.values())


def test_quality_sample_with_a_repeated_id(spark):
    """Rows that share a sampled id count once."""
    rows = [(1, f"copy {k}") for k in range(500)] + [(k, "Some clean prose of a few words.") for k in range(2, 60)] + [(k, "### $$$ %%%") for k in range(60, 120)]
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(1, 120)], "doc_id BIGINT, quality INT")
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    once = frame.groupBy("doc_id").agg(F.min("text").alias("text"))
    assert len(train_quality(frame, labels).rules) == len(train_quality(once, labels).rules) > 0


def test_quality_edges(spark, documents):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 1)], "doc_id BIGINT, quality INT")
    model = train_quality(documents, labels)
    found = score_quality(documents, model)
    assert found.columns.count("score") == 1 and found.count() == documents.count()
    assert found.where("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL").count() == 0
    assert train_quality(documents, labels.limit(0)).rules == []
    assert score_quality(llm_cases.none(spark), model).count() == 0


# -- language model -----------------------------------------------------------------------


def test_unigram_base(documents, rows):
    counts = Counter()
    bags = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    for (d, _), bag, out in zip(rows, bags, held):
        if d is not None and not out:
            counts.update(bag)
    total = sum(counts.values())
    norm = total + 0.1 * (len(counts) + 1)
    expected = [
        (d, out, len(bag), sum(counts[w] > 0 for w in bag), total, round(sum(math.log10((counts[w] + 0.1) / norm) for w in bag), 6))
        for (d, _), bag, out in zip(rows, bags, held)
    ]
    found = score_texts(documents).collect()
    assert sorted(((*r[:5], round(r["base_score"], 6)) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r["score"] < 0 for r in found)


def test_context_tree_against_plain_weighting():
    """Every probability equals a direct evaluation of the recursion over all nodes."""
    texts = [b"abracadabra\n", b"abacab\n", b"cad\n"]
    depth = 2
    codes, counts = counted(gram_codes(texts, depth))
    tree = ContextTree(*decisions(codes, counts), last=depth).mix()
    seen_at = defaultdict(lambda: [0, 0])
    for code, n in zip(codes.tolist(), counts.tolist()):
        byte = code & 255
        for d in range(depth + 1):
            context = code >> 8 & (1 << 8 * d) - 1
            for bit in range(8):
                seen_at[d, context, 1 << bit | byte >> 8 - bit][byte >> 7 - bit & 1] += n

    def kt(pair):
        return math.exp(float(log_kt(np.array([float(pair[0])]), np.array([float(pair[1])]))[0]))

    def weighted(d, context, prefix):
        own = kt(seen_at[d, context, prefix])
        if d == depth:
            return own
        below = {c for e, c, p in list(seen_at) if e == d + 1 and p == prefix and c & (1 << 8 * d) - 1 == context}
        return 0.5 * own + 0.5 * math.prod(weighted(d + 1, c, prefix) for c in below)

    def chance(d, context, prefix):
        zeros, ones = seen_at[d, context & (1 << 8 * d) - 1, prefix]
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == depth:
            return own
        stop = 0.5 * kt((zeros, ones)) / weighted(d, context & (1 << 8 * d) - 1, prefix)
        seen = any(e == d + 1 and c == context & (1 << 8 * (d + 1)) - 1 for e, c, _ in list(seen_at) if seen_at[e, c, _] != [0, 0])
        return stop * own + (1 - stop) * (chance(d + 1, context, prefix) if seen else 0.5)

    for context in (0x6162, 0x6261, 0x7A7A, 0x0A0A, 0x7A61):
        codes = np.array([context << 8 | b for b in range(256)], np.uint64)
        got = 10 ** tree.log10(codes)
        assert abs(got.sum() - 1) < 1e-12
        for byte in (0x61, 0x62, 0x7A, 0x0A):
            p = 1.0
            for bit in range(8):
                one = chance(0, context, 1 << bit | byte >> 8 - bit)
                p *= one if byte >> 7 - bit & 1 else 1 - one
            assert got[byte] == pytest.approx(p, rel=1e-9)


def test_decisions_that_always_went_one_way():
    """At any counts, probabilities stay above zero and add up to one, in the tree's precision."""
    codes, counts = counted(gram_codes([b"ququququququ\n"], 2))
    for scale in (1, 10**6, 10**8, 10**12):
        tree = ContextTree(*decisions(codes, counts * scale), last=2).mix()
        every = np.array([0x7175 << 8 | b for b in range(256)], np.uint64)
        logs = tree.log10(every)
        assert np.isfinite(logs).all() and (10**logs).sum() == pytest.approx(1, abs=1e-5)
        assert logs[0x61] < -math.log10(scale) and logs[0x61] > -8 * (math.log10(scale) + 2)


def _training(rows) -> list[bytes]:
    """What the model learns from."""
    return [prepared((t or "").encode())[1] for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10]


@pytest.mark.parametrize("broadcast", [0, 50, 10**6])
def test_scores_equal_the_whole_tree(documents, rows, monkeypatch, broadcast):
    """Branches weighed in many tasks, and grams broadcast or joined, give what one tree of all
    training text gives; no context is left out."""
    monkeypatch.setattr(lm, "PART_GRAMS", 300)
    monkeypatch.setattr(lm, "FREQUENT_GRAMS", broadcast)
    tree = ContextTree(*decisions(*counted(gram_codes(_training(rows))))).mix()
    expected = sorted((repr(d), float(tree.log10(gram_codes([prepared((t or "").encode())[1]])).sum())) for d, t in rows)
    found = sorted((repr(r["doc_id"]), r["score"]) for r in score_texts(documents).collect())
    assert [d for d, _ in found] == [d for d, _ in expected]
    assert np.allclose([s for _, s in found], [s for _, s in expected], rtol=1e-9)


def test_grams_met_and_not_met(spark, monkeypatch):
    """Also grams whose context the tree does not have at all, at counts of 10^8."""
    monkeypatch.setattr(lm, "PART_GRAMS", 5)
    codes, counts = counted(gram_codes([b"abracadabra\n", b"abacab\n", b"xyxzxy\n"]))
    counts = counts * 10**8
    asked = np.unique(np.r_[codes, gram_codes([b"abraxas \xff\xfe\n", b"zzzzz\n"])])
    grams = spark.createDataFrame(list(zip(codes.astype(np.int64).tolist(), counts.tolist())), "key BIGINT, n BIGINT")
    wanted = spark.createDataFrame([(k,) for k in asked.astype(np.int64).tolist()], "key BIGINT")
    trunk = Shared(spark.sparkContext, lm.fit_trunk(grams, len(codes)))
    found = dict(lm.gram_logs(grams, wanted, trunk, len(codes) + len(asked)).collect())
    whole = ContextTree(*decisions(codes, counts)).mix().log10(asked)
    assert np.allclose([found[k] for k in asked.tolist()], whole, rtol=1e-9) and np.isfinite(whole).all()


def test_scores_beat_the_base_on_held_out_texts(spark):
    found = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    sums = found.select(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_scores_without_text(spark):
    assert score_texts(llm_cases.none(spark)).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id BIGINT, text STRING")
    row = score_texts(one).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["score"] == pytest.approx(4 * 8 * math.log10(0.5))
    assert prepared(b"A  b\n") == ([b"a", b"b"], b"a b\n")


def test_item_hash_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and words(b"It's 2 Words") == [b"it", b"s", b"2", b"words"]


# -- pipeline -----------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark):
    """What each stage makes of all that the one before kept, against plain code on the same rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    items = [words((r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(len(w) - 9, 1)) if w}
    names = [f"_s_{n}" for n in plain_statistics("")]

    def quality(rows):
        values = np.array([list(plain_statistics(t).values()) for _, t in rows])
        total = model.intercept + sum(weight * rule.holds(values, names) for rule, weight in model.rules)
        return [row for row, x in zip(rows, total) if 1 / (1 + math.exp(-x)) >= 0.3]

    def lined(rows):
        return [(d, t) for d, t, _, dropped in plain_lines(rows) if not dropped or t.strip(" ")]

    def near(rows):
        rows = sorted(rows)
        bags = [re.findall(r"[^ \t-\r]+", t.translate(LOWER)) for _, t in rows]
        sets = [{tuple(b[i : i + 5]) for i in range(max(len(b) - 4, 1))} if b else set() for b in bags]
        found = plain_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
        firsts = {}
        for row, c in zip(rows, found):
            firsts.setdefault(c, row)
        return list(firsts.values())

    def clean(rows):
        sizes = {len(w) for w in windows}
        found = [(row, words((row[1] or "").encode())) for row in rows]
        return [row for row, own in found if not any(tuple(own[i : i + n]) in windows for n in sizes for i in range(len(own) - n + 1))]

    for (name, stage), plain in zip(corpus_pipeline.STAGES, (quality, lined, near, clean)):
        docs = stage(spark, docs, sf).cache()
        got = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        rows = sorted(plain(rows))
        assert got == rows, name
    pieces = defaultdict(list)
    used = defaultdict(list)
    for r in corpus_pipeline.STAGES[4][1](spark, docs, sf).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    tokenizer = Tokenizer.from_file(LED)
    assert pieces.keys() == {d for d, _ in rows}
    for d, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc, whole in sorted(pieces[d]):
            assert (start, whole, crc) == (at, len(ids), zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()))
            at += length
        assert at == len(ids)
    for parts in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_stages_on_odd_rows(spark, documents):
    """Nulls in any column, empty and long texts, ties, repeated rows, more columns; and no rows."""
    sf = "/root/testdata/sf0.001"
    for frame in (documents, llm_cases.none(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, frame, sf)
            assert found.dtypes == frame.dtypes and found.count() <= frame.count(), name
        packed = corpus_pipeline.pack(spark, frame, sf)
        assert packed.where("start = 0").count() == frame.count()
    kept = {name: {(r["doc_id"], r["text"]) for r in stage(spark, documents, sf).select("doc_id", "text").collect()} for name, stage in corpus_pipeline.STAGES[1:4]}
    assert (0, None) in kept["lines"] & kept["near copies"] & kept["benchmark"]
    assert any(d is None for d, _ in kept["near copies"]) and any(d is None for d, _ in kept["benchmark"])
