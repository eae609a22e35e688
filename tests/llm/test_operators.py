"""Each operator against a slow, plain version on small rows with the awkward cases in."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, mixing, passages, pii, quality, sharding, simhash, spans, suffixes, token_files
from tidemark.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rnd = random.Random(7)
VOCABULARY = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiouéö") for _ in range(rnd.randint(1, 4))) for _ in range(3000)]


def prose(n, r=rnd):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BENCH = [(0, prose(40)), (1, prose(13).upper()), (2, "six words make a short item"), (3, None), (4, "!!"), (None, prose(20))]


def texts():
    r = random.Random(3)
    base = [prose(120, r) for _ in range(6)]
    passage = prose(60, r)
    out = [None, "", "   ", "one", "a b", "a b c", *base, base[0], base[0], base[1] + " tail", base[2].replace(" ", "  ", 3)]
    out += [prose(30, r) + " " + BENCH[0][1][40:] + " " + prose(10, r), prose(700, r) + " " + BENCH[0][1], BENCH[1][1] + ". end", "Six, words make A short item!", BENCH[5][1]]
    out += [prose(40, r) + " " + passage + " " + prose(20, r), passage, prose(70, r) + "\n" + passage.title(), "spam " * 400, "x" * 100_000, prose(20_000, r)]
    words = (passage + " " + prose(30, r)).split()
    words[10], words[35] = "changed", "also"
    return [*out, prose(25, r) + " " + " ".join(words[:70]), prose(50, r) + " " + passage + " " + " ".join(words[60:])]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts())]
    return [*made, made[6], made[6], (None, "no id " * 10, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_empty_and_extra_columns(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    for made in (
        decontaminate.op1_digest(none, bench), mixing.op2_digest(none), sharding.op3_digest(none), passages.op4_digest(none), token_files.op5_digest(none),
        simhash.op7_digest(none), quality.op8_digest(none), suffixes.op9_digest(none), pii.op10_digest(none),
    ):
        assert made.collect() == []
    assert decontaminate.op1_digest(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0
    odd = docs.withColumns({c: F.lit(1) for c in ("row", "d", "h", "words", "fp", "kept", "quality", "s", "steps", "copy", "u", "text_hash", "part", "th", "doc", "code")})
    for f in (quality.clean, simhash.one_of_each, lambda x: decontaminate.decontaminate(x, bench), lambda x: mixing.mix(x).select("row.*")):
        made = f(odd)
        assert made.columns == odd.columns and made.count() == f(docs).count()


def brute_hits(text, bench):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    w, hit, items = find(text), set(), set()
    for item, t in bench:
        v = find(t)
        n = min(13, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    items |= {str(item)} - {"None"}
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, docs, rows, limit):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    want = sorted(((r[0], *brute_hits(r[1], BENCH)) for r in rows), key=repr)
    made = decontaminate.op1_digest(docs, bench) if limit else None
    if limit:
        assert got(made, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    found = decontaminate.contamination(docs, bench, limit).filter(decontaminate.contaminated())
    assert got(found, "doc_id", "n_hit") == sorted(((w[0], w[2]) for w in want if w[-1]), key=repr)
    kept = decontaminate.decontaminate(docs, bench, limit)
    assert kept.columns == docs.columns and got(kept, "doc_id") == sorted(((w[0],) for w in want if not w[-1]), key=repr)


def test_mixing(spark, docs, rows):
    weights = spark.createDataFrame([("src0", 3.0), ("src1", 1.0), (None, 1.0)], "source string, weight double")
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights).collect()}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode()) + 1
    for s, w in (("src0", 0.6), ("src1", 0.2), (None, 0.2), ("src2", 0.0)):
        assert rates[s] == pytest.approx(w * sum(sizes.values()) / sizes[s])
    out = mixing.mix(docs, weights).select("row.*", "copy", "n_copies", "shuffle_key").collect()
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    each = mixing.mix(many, spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")).groupBy("row.source").count()
    assert {r[0]: r[1] for r in each.collect()} == pytest.approx({"a": 20_000, "b": 20_000}, rel=0.03)
    for rate in (50.0, 2000.0, 3e6):
        big = mixing.distributions(spark.createDataFrame([("x", rate)], "source string, rate double")).first()
        assert big.steps[-1] == pytest.approx(1) and big.least + sum(c <= 0.5 for c in big.steps) == pytest.approx(rate, abs=2)
        assert len(big.steps) <= 24 * rate**0.5 + 85
    one = mixing.mix(docs, weights)
    old, mixing.BROADCAST_BYTES, mixing.CHUNK = (mixing.BROADCAST_BYTES, mixing.CHUNK), 0, 2
    assert got(one, "doc_id", "copy") == got(mixing.mix(docs, weights), "doc_id", "copy")
    mixing.BROADCAST_BYTES, mixing.CHUNK = old


def test_sharding(docs, rows):
    out = sharding.op3_digest(docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=key)
    assert [r[:3] for r in sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out), key=lambda r: (r[3], r[4]))] == want
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    sizes = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(w[1] for w in want)


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    end = "<|endoftext|>"
    marked = [end, f"hello {end} x", f"{end}a b{end}", f"a b {end}", f"{end} {end}", "<|endoftext|", f" {end}\n{end}  x"]
    odd = [(2000 + i, t, "", "", 0) for i, t in enumerate(marked)]
    odd += [(1000 + i, t, "", "", 0) for i, t in enumerate(["a  b", " a", "a ", "a \n b", "a\n\n  b c", "x \t y z", "don't 12 34 <|endoftext|> é  \n", "a b", "\n", "a' s 't"])]
    every = [*rows, *odd]
    out = f"file://{tmp_path}/tokens"
    token_files.write_tokens(spark.createDataFrame(every, DOCS), out)
    made = sorted(token_files.read_tokens(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    assert [r.doc_id for r in made] == sorted((r[0] for r in every), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in made:
        assert r.ids in [encode(x[1]) for x in every if x[0] == r.doc_id]
        assert (r.start, r.n_tokens) == (start, len(r.ids)) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        start += r.n_tokens
    assert token_files.read_document(spark, out, 1003) == [encode("a \n b")]


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>\\<|turn|>user\n", "\\\\<\\|\\", "<", "", None, "a<\\;b\n|>", "<<||>>"]
    rows = [(c, t, ("user", "assistant")[t % 2], odd[(c + t) % len(odd)]) for c in range(9) for t in range(c + 1)] + [(3, 1, "ro\nle", "x"), (3, 1, "ro\nle", "x"), (None, None, None, None)]
    made = {r.conv_id: r for r in chat.op6_digest(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    rows += [(-1, 0, "user", odd[0]), (-1, 1, "assistant", odd[0])]
    for c in {r[0] for r in rows}:
        turns = sorted((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert made[c].n_turns == len(turns)
        assert made[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (made[c].loss_chars, made[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees(spark):
    # r - a - b - c (scores up), a - d (best mean), lone root, a cycle, an orphan
    nodes = [("t", "r", None, 0.0), ("t", "a", "r", 1.0), ("t", "b", "a", 2.0), ("t", "c", "b", 1.0), ("t", "d", "a", 9.0), ("t", "e", "d", None), ("u", "l", None, 1.0), ("v", "x", "y", 1.0), ("v", "y", "x", 1.0), ("w", "o", "gone", 1.0)]
    frame = spark.createDataFrame(nodes, "tree string, node string, parent string, score double")
    best = {}
    for r in sorted(chat.paths(frame, keep=2).collect(), key=lambda r: (r.tree, r.branch, r.turn)):
        best.setdefault((r.tree, r.branch), []).append(r.node)
    assert best == {("t", 1): ["r", "a", "d", "e"], ("t", 2): ["r", "a", "b", "c"], ("u", 1): ["l"], ("w", 1): ["o"]}
    said = spark.createDataFrame([(n[1], "assistant" if n[1] in "ac" else "user", f"says {n[1]}") for n in nodes], "node string, role string, text string")
    one = chat.format_paths(said, chat.paths(frame)).filter("tree = 't'").first()
    assert one.formatted.count("<|turn|>") == 4 and [one.formatted[s.start : s.end] for s in one.loss_spans] == ["says a"]


def brute_path(nodes, tree):
    """The nodes of the best leaf of a tree, by mean score, turns and the head of its last run."""
    mine = {n: (p, s or 0.0) for t, n, p, s in nodes if t == tree}
    parents = [p for _, _, p, _ in nodes]
    found = []
    for n in mine:
        if n not in parents:
            path, at = [], n
            while at in mine and at not in path:
                path.append(at)
                at = mine[at][0]
            if at not in mine:
                found.append((sum(mine[x][1] for x in path) / len(path), len(path), path[::-1]))
    return sorted(found, key=lambda x: (-x[0], -x[1]))


def test_combs_and_random_trees(spark):
    r = random.Random(4)
    nodes = [("comb", "c0", None, 0.5)]
    for i in range(1, 70):
        nodes += [("comb", f"c{i}", f"c{i - 1}", r.random()), ("comb", f"l{i}", f"c{i - 1}", r.random() / 9)]
    for t in range(4):
        nodes += [(f"t{t}", f"{t}.0", None, 1.0)] + [(f"t{t}", f"{t}.{i}", f"{t}.{r.randrange(max(0, i - 4), i)}", r.random()) for i in range(1, 60)]
    nodes += [("loop", "x", "z", 1.0), ("loop", "y", "x", 1.0), ("loop", "z", "y", 1.0), ("loop", "w", "x", 1.0), ("loop", "v", "w", 1.0)]
    frame = spark.createDataFrame(nodes, "tree string, node string, parent string, score double")
    made = {}
    for x in sorted(chat.paths(frame, keep=2).collect(), key=lambda x: (x.tree, x.branch, x.turn)):
        made.setdefault((x.tree, x.branch), []).append(x.node)
    want = {(t, k + 1): x[2] for t in {n[0] for n in nodes} for k, x in enumerate(brute_path(nodes, t)[:2])}
    assert made == want and len(want) == 10


def test_chat_of_nothing_and_of_long_texts(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, tree int, node int, run int"
    none = chat.op6_digest(spark.createDataFrame([], kind)).collect()
    assert [r.conv_id for r in none] == [-1]
    said = "<|end|>" * 50_000
    made = {r.conv_id: r for r in chat.op6_digest(spark.createDataFrame([(1, 0, "assistant", said, 1, 1, 1)], kind)).collect()}
    assert made[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and made[1].formatted_chars == len(said) + 50_000 + len("<|turn|>assistant\n<|end|>")


def brute_components(fps):
    root = list(range(len(fps)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(of(i), of(j))] = min(of(i), of(j))
    return [of(i) for i in range(len(fps))]


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("dense", [64, 2])
def test_simhash(spark, docs, rows, dense):
    old, simhash.DENSE = simhash.DENSE, dense
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    want = []
    for i, r in enumerate(rows):
        ids = [x[0] for x, z in zip(rows, roots, strict=True) if z == roots[i] and x[0] is not None]
        want.append((r[0], f"{fps[i]:016x}", min(ids, default=None)))
    assert got(simhash.op7_digest(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(roots))
    r = random.Random(1)
    some = [r.getrandbits(64) for _ in range(300)]
    for _ in range(500):
        some.append(r.choice(some) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    some += [some[0] ^ (1 << i) for i in range(64)] + [some[0] ^ (1 << i) ^ (1 << i + 1) for i in range(63)]
    some = sorted({x - (1 << 64) if x >> 63 else x for x in some})
    linked = simhash.links(spark.createDataFrame([(x,) for x in some], "fp bigint"))
    top = {x.node: x.root for x in components(linked).collect()}
    want = brute_components([x & (1 << 64) - 1 for x in some])
    groups = lambda z: sorted(sorted(i for i in range(len(some)) if z[i] == k) for k in set(z))
    assert groups([top.get(x, x) for x in some]) == groups(want)
    simhash.DENSE = old


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (5, 5)]
    made = {r.node: r.root for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert made == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}


def test_golay():
    import numpy as np

    assert (simhash.error_table() >= 0).all()
    r = np.random.default_rng(0)
    one = r.integers(0, 1 << 63, 2000)
    for flips in (0, 1, 2):
        two = one.copy()
        for _ in range(flips):
            two ^= np.int64(1) << r.integers(0, 63, len(two))
        a, b = (set(zip(*map(lambda v: v.tolist(), simhash.keys_of(x)), strict=True)) for x in (one, two))
        assert {i for i, _ in a & b} == set(range(len(one)))


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality(spark):
    import base64

    noise = base64.b85encode(random.Random(1).randbytes(9000)).decode()
    made = [t for t in texts() if len(t or "") < 50_000] + ["a b c a b c a b", "x\n\nx\n y\n y\nx#<>|", "a b c d\x1ce", " ".join(noise[i : i + 9] for i in range(0, len(noise), 9)), "lorem ipsum dolor " + prose(80) + " ab" * 3]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in quality.op8_digest(frame).collect()}
    for i, t in enumerate(made):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), t
        low, high = quality.band(len((t or "").encode()))
        assert r.kept == (not r.base_failed and low <= r.ratio <= high and r.bad_chunks <= quality.BAD_CHUNKS)
    assert out[6].kept and not out[len(made) - 2].kept


def brute_runs(words, least):
    """Of each document the words inside runs of at least so many that another document has too."""
    holders = {}
    for i, a in enumerate(words):
        for x in range(len(a) - least + 1):
            holders.setdefault(tuple(a[x : x + least]), set()).add(i)
    return {
        i: {x + k for x in range(len(a) - least + 1) if holders[tuple(a[x : x + least])] != {i} for k in range(least)} for i, a in enumerate(words)
    }


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert (r.mate_id is None or r.mate_id != r.doc_id) and r.n_words == r.end_word - r.start_word
    return out


def clashing(frame):
    return frame.withColumns({c: F.lit(1) for c in ("code", "ref", "doc", "wide", "part", "start", "mate", "at", "low", "key", "c")})


def test_suffixes(spark):
    made = texts()
    words = [(t or "").encode().lower().split() for t in made]
    frame = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(made)] * 2, "doc_id bigint, text string"))
    out = suffixes.op9_digest(frame)
    assert covered(out) == {i: w for i, w in brute_runs(words, suffixes.LEAST).items() if w}
    for r in out.collect():
        assert r.first == (r.mate_id > r.doc_id)


def excerpts(seed, n=60):
    """Documents that hold excerpts of one passage, 55 to 99 words long."""
    r = random.Random(seed)
    passage, out = prose(400, r).split(), []
    for _ in range(n):
        size = r.randint(55, 99)
        at = r.randrange(400 - size)
        out.append(" ".join([prose(r.randint(20, 60), r), *passage[at : at + size], prose(r.randint(20, 60), r)]))
    return out


def shared_words(seed, n=40):
    """Documents over four words only, so that runs of all lengths are shared, with stretches of one another."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [r.choice("abcd") + str(r.randrange(3)) for _ in range(r.randint(0, 150))]
        for _ in range(r.randrange(3)):
            mate = r.choice(out or [["a"] * 60])
            at, size = r.randrange(len(mate) or 1), r.randint(45, 70)
            words[r.randrange(len(words) + 1) : 0] = mate[at : at + size]
        out.append(words)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("seed", "make"), [(1, excerpts), (2, shared_words), (3, shared_words)])
def test_no_shared_run_is_missed(spark, seed, make):
    made = make(seed)
    words = [t.split() for t in made]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    want = {i: w for i, w in brute_runs(words, suffixes.LEAST).items() if w}
    assert len(want) > 10 and covered(suffixes.op9_digest(frame)) == want
    found = covered(passages.op4_digest(frame))
    assert set(want) <= set(found)
    assert sum(len(w & found[i]) for i, w in want.items()) >= 0.99 * sum(map(len, want.values()))


def test_null_ids_and_repeated_words(spark):
    r = random.Random(13)
    one = prose(80, r)
    rows = [(None, one), (None, one + " more"), (1, "spam " * 300), (2, "spam " * 200), (3, ""), (4, None), (4, one), (4, prose(80, r)), (5, "a b c d")]
    words = [(t or "").split() for _, t in rows]
    want = brute_runs(words, suffixes.LEAST)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for op in (suffixes.op9_digest, passages.op4_digest):
        got_ = covered(op(frame))
        assert set(got_) == {None, 1, 2, 4} and len(got_[1]) == 300 and len(got_[2]) == 200
        assert got_[4] >= want[6] and len(want[6]) == 80


def test_ranges():
    import numpy as np

    r = np.random.default_rng(1)
    codes = r.integers(0, 3, 500).astype(np.uint32)
    ranges = spans.Ranges(codes)
    start = r.integers(0, 480, 4000)
    stop = start + r.integers(1, 20, 4000)
    named = {}
    for h, a, z in zip(ranges.of(start, stop).tolist(), start.tolist(), stop.tolist(), strict=True):
        assert named.setdefault(h, codes[a:z].tolist()) == codes[a:z].tolist()
    assert len(named) == len({tuple(codes[a:z].tolist()) for a, z in zip(start, stop, strict=True)})


def test_seeds_go_to_the_range_of_their_code():
    import numpy as np

    r = np.random.default_rng(2)
    points = (np.array([1, 3, 3, 3, 7]), np.array([5, -4, 0, 9, 2]))
    code, ref = r.integers(0, 9, 500), r.integers(-12, 12, 500)
    want = [sum((c, f) <= (a, b) for c, f in zip(*points, strict=True)) for a, b in zip(code, ref, strict=True)]
    assert spans.part_of(code, ref, points).tolist() == want


def seed_rows(spark, rows):
    return spark.createDataFrame([(c << 2 | n, d, p) for c, n, d, p in rows], "code bigint, ref bigint, pos int")


@pytest.mark.parametrize("parts", [1, 7])
def test_every_shared_seed_is_linked(spark, parts):
    r = random.Random(5)
    rows = sorted({(r.choice([1, 1, 1, 2, 3, 4]), r.randrange(3), r.randrange(40), r.randrange(5)) for _ in range(600)})
    rows += sorted({(c, 0, d, p) for c in range(5, 45) for d in range(r.randint(1, 3)) for p in r.sample(range(50), r.choice([1, 2, 9]))})
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    made = spans.neighbours(seed_rows(spark, rows).repartitionByRange(parts, *spans.ORDER), 2)[0].collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    groups = {}
    for c, _, d, p in rows:
        groups.setdefault((d, p), set()).add(c)
    for x in made:
        assert x.a_ref > x.b_ref and groups[x.a_ref, x.a_pos] & groups[x.b_ref, x.b_pos]
    linked = {(x[0], x[1]) for x in made} | {(x[2], x[3]) for x in made}
    shared = {c for c in range(45) if len({x[2] for x in rows if x[0] == c}) > 1}
    assert {(x[2], x[3]) for x in rows if x[0] in shared} <= linked
    assert len(made) <= 2 * len(rows)


def test_a_passage_twice_in_the_first_document(spark):
    r = random.Random(8)
    passage = prose(70, r)
    twice = " ".join([prose(20, r), passage, prose(300, r), passage, prose(20, r)])
    docs = spark.createDataFrame([(1, twice), (2, prose(15, r) + " " + passage + " " + prose(15, r))], "doc_id bigint, text string")
    for op in (suffixes.op9_digest, passages.op4_digest):
        assert {*range(20, 90), *range(390, 460)} <= covered(op(docs))[1]


def test_chains():
    """Against all chains, tried one by one: the best one comes first and has their best score."""
    r = random.Random(2)
    gap, gram = passages.GAP, passages.GRAM
    for _ in range(150):
        m = sorted({(r.randrange(80), r.randrange(80)) for _ in range(r.randint(1, 30))})
        a, b = [x for x, _ in m], [y for _, y in m]
        more = [r.choice([0, 0, 3, 12]) for _ in m]
        score = []
        for j in range(len(m)):
            best = (0.0, 0.0)
            for i in range(j):
                x, y = a[j] - a[i] - more[i], b[j] - b[i] - more[i]
                if x > 0 and y > 0 and (gain := score[i] - gap * (x + y - 2 * gram)) > 0:
                    best = max(best, (gain, gain + min(gram, x, y)))
            score.append(best[1] + more[j] + (gram if best[0] <= 0 else 0))
        found = passages.chains(a, b, more)
        assert sorted(x for c in found for x in c) == list(range(len(m)))
        assert score[found[0][-1]] == pytest.approx(max(score), abs=gram)
        for c in found:
            assert all(a[x] + more[x] < a[y] and b[x] + more[x] < b[y] for x, y in zip(c, c[1:], strict=False))


def test_stretches():
    import numpy as np

    r = random.Random(3)
    for _ in range(100):
        m = sorted({(r.randrange(60), r.randrange(60)) for _ in range(40)} | {(i, i + 7) for i in r.sample(range(50), 20)})
        a, b, more = passages.stretches(*(np.array(x) for x in zip(*m, strict=True)))
        want = {(x + k, y + k) for x, y in m for k in range(passages.GRAM)}
        assert {(x + k, y + k) for x, y, n in zip(a.tolist(), b.tolist(), more.tolist(), strict=True) for k in range(n + passages.GRAM)} == want
        assert list(zip(a, b, strict=True)) == sorted(zip(a, b, strict=True))


def test_passages(spark):
    made = texts()
    words = [(t or "").encode().lower().split() for t in made]
    frame = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(made)] * 2, "doc_id bigint, text string"))
    rows = passages.op4_digest(frame)
    out = covered(rows)
    assert all(r.score >= passages.ALIKE for r in rows.collect())
    for i, want in brute_runs(words, 50).items():
        assert want <= out.get(i, set()), i
    near = brute_runs(words, 12)
    clean = {i for i, w in near.items() if not w}
    assert clean and not clean & set(out)
    fuzzy = next(i for i, a in enumerate(words) if b"changed" in a and b"also" in a)
    assert len(out[fuzzy]) >= 45


def test_spelled_digits_among_figures():
    cases = {
        "phone": ["plus 4 nine 1 seven 2 three 3 four 5 six 6", "plus four 4 two 0 seven 9 four 6 zero 9 five 8"],
        "card": ["four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1"],
        "ip": ["one dot 2 dot three dot four"],
    }
    for kind, texts_ in cases.items():
        for t in texts_:
            for text in (f"schön: {t}; ok", f"call ({t})", f"call ({t}) or one two three"):
                assert t in [text[a:z] for a, z in pii.search(text)[1][kind]], (text, pii.search(text))
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice([" one", " TWO", "-three", ",vier", " 5", " 67", " dot", " point", "plus ", "(", ")", ";", "x", " fİve", " sıx", "_", "\n"]) for _ in range(9))
        if any(pii._digits(m[0], m.start()) for m in pii._RUN.finditer(text)):
            assert pii.spelled_run(text.lower()), text


def varied(words, r, changes):
    out = list(words)
    for i in changes:
        out[i] = prose(1, r) + "x"
    return " ".join([prose(30, r), *out, prose(30, r)])


def test_every_one_of_many_variants_is_found(spark):
    r = random.Random(10)
    passage = prose(50, r).split()
    made = [(i, varied(passage, r, r.sample(range(3, 47), 3))) for i in range(100)]
    out = passages.op4_digest(spark.createDataFrame(made, "doc_id bigint, text string"))
    assert len({x.doc_id for x in out.collect()}) >= 95


def test_sparse_changes_leave_a_seed_in_every_passage(spark):
    r = random.Random(11)
    made = []
    for i in range(30):
        words = prose(60, r).split()
        made += [(2 * i, varied(words, r, [])), (2 * i + 1, varied(words, r, range(6, 60, 6)))]
    out = passages.op4_digest(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert {x.doc_id for x in out} == set(range(60)) and all(x.n_words >= passages.LEAST for x in out)


def test_alike_passages_among_many_others_that_share_their_seeds(spark):
    """Each run of words that two alike passages share stands in 40 other documents too, in other surroundings."""
    r = random.Random(21)
    made, runs = [], []
    for i in range(12):
        words = prose(60, r).split()
        made += [(2 * i, varied(words, r, [])), (2 * i + 1, varied(words, r, range(7, 60, 8)))]
        runs += [words[max(0, k - 7) : k] for k in range(7, 68, 8)]
    for i in range(24, 64):
        r.shuffle(runs)
        made.append((i, " ".join(f"{prose(14, r)} {' '.join(x)}" for x in runs)))
    out = covered(passages.op4_digest(spark.createDataFrame(made, "doc_id bigint, text string")))
    assert set(range(24)) <= set(out) and all(len(out[i]) >= 55 for i in range(24))


def test_copies_of_a_text_are_whole_passages(spark):
    """Also where no shingle of it is a seed; the first stands beside the next one, all others beside the first."""
    r = random.Random(31)
    seedless = next(w for i in range(99) if not len(passages.kept_shingles(spans.word_codes((w := f"w{i} ") * 60))["pos"]))
    rows = [(i, seedless * 60) for i in range(5, 25)] + [(30, prose(80, r)), (31, prose(80, r))]
    rows += [(40, rows[-1][1]), (41, "few words"), (42, "few words"), (None, rows[-1][1])]
    out = {x.doc_id: (x.start_word, x.end_word, x.mate_id, x.first) for x in passages.op4_digest(spark.createDataFrame(rows * 2, "doc_id bigint, text string")).collect()}
    want = {i: (0, 60, 5, False) for i in range(6, 25)} | {5: (0, 60, 6, True)}
    assert out == want | {31: (0, 80, None, False), 40: (0, 80, None, False), None: (0, 80, 31, True)}


def test_a_repeated_word_has_seeds_at_its_ends(spark):
    """Seeds of a run grow with it by one in 40 words, and cover it; what follows and comes before is found in documents whose runs differ."""
    import numpy as np

    word = next(w for i in range(99) if len(passages.kept_shingles(spans.word_codes((w := f"w{i} ") * 60))["pos"]))
    for n in (45, 46, 89, 400):
        pos = passages.kept_shingles(spans.word_codes(word * n))["pos"]
        assert len(pos) <= 3 + n // 40 and {0, n - 5} <= set(pos.tolist())
        assert {x for p in pos if p + 45 <= n for x in range(p, p + 45)} == set(range(n))
    assert passages.ends_of_runs(np.array([3, 3, 3, 4, 5, 5]))[1].tolist() == [False, False, True, False, False, True]
    r = random.Random(32)
    head, tail, made = prose(30, r), prose(30, r), []
    for i in range(12):
        made.append((i, " ".join([prose(20, r), head, word * (50 + 30 * i), tail, prose(20, r)])))
    for i, got_ in covered(passages.op4_digest(spark.createDataFrame(made, "doc_id bigint, text string"))).items():
        assert got_ >= set(range(20, 20 + 30 + 50 + 30 * i + 30))


def test_pairs_that_can_be_alike_pass():
    """Any two passages of 45 words of which nine at most differ, by change, loss or addition, beside anything."""
    import numpy as np

    from tidemark.llm import partners

    r = random.Random(22)
    size = partners.BEFORE + partners.LEAST
    rows = []
    for _ in range(200):
        a = [r.randrange(1, 256) for _ in range(size)]
        at, keep = r.randint(0, 35), set(range(40, 45))
        b = list(a)
        spots = r.sample([i for i in range(at, at + 45) if i not in keep and at <= i], 9)
        for i in spots:
            b[i] = r.randrange(1, 256)
        b[:at] = [r.randrange(1, 256) for _ in range(at)]
        b[at + 45 :] = [r.randrange(1, 256) for _ in range(size - at - 45)]
        if r.random() < 0.5:  # a word lost after the seed, and one more before it
            b = [*b[1:20], 7, *b[20:60], *b[61:], 9]
            b = b[:size]
        rows += [a, b]
    words = np.array(rows, np.uint8)
    n = np.arange(len(rows))
    got_ = {(int(x), int(y)) for a, b in partners.compared(n, n, n, words) for x, y in zip(a, b, strict=True)}
    changed = [(i, i + 1) for i in range(0, len(rows), 2) if (words[i, 40:45] == words[i + 1, 40:45]).all() and sum(words[i, 5:80] == words[i + 1, 5:80]) >= 36]
    assert len(changed) > 50 and set(changed) <= got_ and len(got_) < 2 * len(rows)


def test_pii():
    plain = "mail a.b@x-y.co.uk, 10.0.0.256 10.0.0.255 card 4111 1111 1111 1111 +1 (415) 555-0100 done"
    base, added = pii.search(plain)
    assert [plain[a:z] for k in pii.KINDS for a, z in base[k]] == ["a.b@x-y.co.uk", "10.0.0.255", "4111 1111 1111 1111", "+1 (415) 555-0100"]
    assert not any(added.values()) and pii.search(None) == pii.search("")
    cases = {
        "email": ["jane (at) host [dot] com", "jane.doe at host dot com", "jаne@host.com", "jane＠host．com", "jane{at}mail.host(dot)org"],
        "ip": ["192(dot)168[dot]1 [dot] 20", "１９２．１６８．１．２０", "one nine two dot one six eight dot one dot two zero"],
        "phone": ["plus four four two zero seven nine four six zero nine five eight", "＋1 415 555 0100", "plus eins vier eins fünf 555 0100"],
        "card": ["four one one one one one one one one one one one one one one one", "４１１１１１１１１１１１１１１１"],
    }
    for kind, texts_ in cases.items():
        for t in texts_:
            text = f"schön: {t}; ok"
            _, more = pii.search(text)
            assert [text[a:z] for a, z in more[kind]] == [t], (kind, t, more)
    for t in ("we met at noon and dot the i", "one two three", "un deux trois quatre", prose(300), "look at the dot here", "a (at) b"):
        assert pii.search(t)[0] == pii.search(t)[1], t
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", "é", "а", "＠", ".", " ", "1", "２", " one", " two", " three", " dot ", "(at)", "+", "@b.c"]) for _ in range(40))
        base, more = pii.search(text)
        for k in pii.KINDS:
            assert all(0 <= a < z <= len(text) for a, z in more[k])


#: The contract's patterns as they are written there.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def luhn(d):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0

    out = []
    for i, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = "".join(c for c in m[0] if c in "0123456789")
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


def test_base_spans_against_the_plain_patterns():
    r = random.Random(12)
    bits = ["a", ".", "@", "@b.c", "x-y", "_", "%", " ", "1", "25", "300", ".4", "+", "+1", "4111 1111 1111 1111", "(4)", "-", "é", "\n"]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        found = sorted((a, i, z, k) for i, k in enumerate(pii.KINDS) for a, z in pii.find(text)[k])
        assert found == brute_spans(text), text


def test_pii_digest(spark, docs, rows):
    odd = ["a.b@c.d " * 3, "10.0.0.1 +1 (415) 555-0100", "jane (at) host [dot] com", "x" * 300_000 + "@h.io [at]", "", None]
    every = [*rows, *[(5000 + i, t, None, None, None) for i, t in enumerate([*odd, odd[0]])], (5000, odd[1], None, None, None)]
    frame = spark.createDataFrame(every, DOCS).withColumns({c: F.lit(1) for c in ("spans", "n_email", "base_sha256")})
    made = got(pii.op10_digest(frame), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for d, t, *_ in every:
        spans_ = brute_spans(t)
        said = ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans_)
        want.append((d, *(sum(s[3] == k for s in spans_) for k in BASE), hashlib.sha256(said.encode()).hexdigest()))
    assert made == sorted(want, key=repr)


def test_pii_takes_time_in_proportion():
    import time

    n = 1_000_000
    for text in ("x" * n + " a [at] b a@b.c", "1" * n + " (at) a@b.c", "a@" * (n // 2), "x (dot) at " * (n // 11), " " * n + "(at)", "one point " * (n // 10)):
        begun = time.process_time()
        pii.search(text)
        assert time.process_time() - begun < 15


def test_sums_of_blanks_between_user_and_sign():
    for text, want in {
        "jane   (at)   host [dot] com": "jane   (at)   host [dot] com",
        "a@b (at) c (dot) org": "b (at) c (dot) org",
        "x (dot) y (at) host dot com": "x (dot) y (at) host dot com",
    }.items():
        assert [text[a:z] for a, z in pii.search(text)[1]["email"]] == [want]


def test_likely_chains():
    """Chains with a passage are never dropped beforehand, and most chance matches are."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(21)
    rows = []
    for _ in range(1500):
        a = [r.randrange(1, 1000) for _ in range(r.randint(5, 140))]
        rate = r.choice([0, 0.05, 0.2, 1])
        b = [x if r.random() > rate else -x for x in a]
        for _ in range(r.randrange(3)):
            del b[r.randrange(len(b)) : len(b) if r.random() < 0.05 else 1]
        if len(b) < 5:
            continue
        p = r.randrange(len(a) - 4)
        q = min(p, len(b) - 5)
        b[q : q + 5] = a[p : p + 5]
        cut = lambda v, k: v[max(0, k - passages.MARGIN) : k] + v[k + 5 : k + 5 + passages.MARGIN]
        rows.append((1, 2, [p], [q], [5], *passages._between([p], [5]), *passages._between([q], [5]), cut(a, p), cut(b, q)))
    names = [*(x.split()[0] for x in passages._CHAINS.split(", ")), "a_codes", "b_codes"]
    kinds = [pa.int64()] * 2 + [pa.list_(pa.int32())] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    count = lambda: [sum(x.num_rows for x in passages._align([batch.slice(i, 1)])) for i in range(batch.num_rows)]
    made = count()
    old, passages._likely = passages._likely, lambda at, *_: np.ones(len(at.start) - 1, bool)
    whole = count()
    likely = old(*(passages.Lists(batch.column(c)) for c in ("at", "to", "words", "a_many", "b_many", "a_codes", "b_codes")))
    passages._likely = old
    assert sum(whole) > 200 and sum(made) >= 0.99 * sum(whole) and likely.sum() < 0.9 * len(rows)
