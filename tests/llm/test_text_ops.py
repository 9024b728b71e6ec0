"""Line dedup, SimHash, mixing, encoding and token counts against brute force."""

import dataclasses
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import line_dedup, piece_dropout, simhash, source_mix, trie_counts
from tessera.llm.pieces import SPACE, load_pieces, merge_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def pieces():
    return load_pieces()


def texts(n=60, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "THE", "of", "é", "日本"]
    out = []
    for i in range(n):
        if i % 4 == 3:  # a near copy
            lines = out[r.randrange(len(out))].split("\n")
            cut = [ln.split(" ") for ln in lines]
            for ln in cut:
                if r.random() < 0.5:
                    ln[r.randrange(len(ln))] = r.choice(words)
            out.append("\n".join(" ".join(ln) for ln in cut))
        else:
            out.append("\n".join(" ".join(r.choice(words) for _ in range(r.randrange(1, 25))) for _ in range(r.randrange(1, 6))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def awkward(n=60):
    rows = [(i, t, ["a", "b", "b", None][i % 4]) for i, t in enumerate(texts(n))]
    rows += [(100, "", "a"), (101, None, "a"), (102, " \t\n ", "c"), (103, "one", "c"), (103, "one", "c"), (None, "null id here\nyes", "c"), (104, "x " * 9000, "d"), (105, "▁ under bar ▁▁ \r\n\ttab", "d"), (106, "\x00nul", "d")]
    return rows


def words_of(text):
    return [w for w in "".join(c if c not in "\t\n\x0b\f\r" else " " for c in text).split(" ") if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, threshold=0.8):
    """doc text after removal, by comparing each line with every earlier one."""
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    docs = sorted({(line_dedup.LAST_ID if i is None else i, signed(t), t) for i, t, _ in rows if t is not None})
    seen, out = [], {}
    for i, h, t in docs:
        kept = []
        for line in t.split("\n"):
            w = set(words_of(lower(line)))
            if w and any(len(w & s) >= threshold * len(w | s) - 1e-12 for s in seen):
                seen.append(w)
                continue
            if w:
                seen.append(w)
            kept.append(line)
        out[i, h] = "\n".join(kept)
    return {(i, t): None if t is None else out[line_dedup.LAST_ID if i is None else i, signed(t)] for i, t, _ in rows}


def test_line_dedup_matches_brute_force(spark):
    rows = awkward(120)
    want = brute_lines(rows)
    docs = frame(spark, rows).withColumn("key", F.lit(1)).withColumn("was", F.col("text"))
    got = line_dedup.drop_repeated_lines(docs, lines_col="n_lines", kept_col="n_kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[r["doc_id"], r["was"]], r
        assert r["n_lines"] == (0 if r["was"] is None else r["was"].count("\n") + 1)
    assert sum(r["n_kept"] for r in got) < sum(r["n_lines"] for r in got)


def test_line_dedup_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"t{i}" for i in range(30)]
    rows = []
    for i in range(150):
        line = base[:]
        for _ in range(r.randrange(0, 4)):
            line[r.randrange(30)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(line), "a"))
    want = brute_lines(rows)
    got = line_dedup.drop_repeated_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: want[i, t] for i, t, _ in rows}


def test_line_keys_are_sorted_as_plain_numbers(spark):
    r = random.Random(3)
    levels = [r.randrange(32) for _ in range(line_dedup.BUCKETS)]
    lines = frame(spark, [(1, "The the  of \t one\x0btwo", "a"), (2, " ".join(f"w{i}" for i in range(300)), "a"), (3, "", "a")])
    words = lines.select(line_dedup.words_of(F.col("text"), line_dedup.odd_space(F.col("text"))).alias("hashes"))
    got = words.select("hashes", line_dedup._sorted_keys(F.col("hashes"), levels).alias("keys"))
    assert not got.schema["keys"].dataType.containsNull
    for row in got.collect():
        assert row["keys"] == sorted(levels[h & (line_dedup.BUCKETS - 1)] << 58 | (h % (1 << 64)) >> 6 for h in row["hashes"])


def test_line_keys_leave_the_table_out_of_the_plan(spark):
    keys = spark.range(1).select(line_dedup._sorted_keys(F.array(F.xxhash64("id")), [31] * line_dedup.BUCKETS).alias("keys"))
    assert len(keys._jdf.queryExecution().toString()) < 10_000
    assert keys.collect()[0]["keys"][0] >> 58 == 31


def test_line_dedup_leaves_white_space_as_it_is(spark):
    rows = [(1, "Alpha  beta\tgamma ", "a"), (2, "\nAlpha beta gamma\n \x0b\ndelta  epsilon\r\n", "a"), (3, "\n\n", "a"), (4, "zeta\neta", "a")]
    got = line_dedup.drop_repeated_lines(frame(spark, rows), lines_col="n_lines", kept_col="n_kept").collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in got} == {
        1: ("Alpha  beta\tgamma ", 1, 1), 2: ("\n \x0b\ndelta  epsilon\r\n", 5, 4), 3: ("\n\n", 3, 3), 4: ("zeta\neta", 2, 2)}


def test_line_dedup_empty_and_pipeline_form(spark):
    empty = frame(spark, []).withColumn("line_no", F.lit(1))
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    rows = [(1, "alpha beta gamma\ndelta", "a"), (2, "alpha beta gamma", "a"), (3, "", "a"), (4, None, "a"), (5, "delta\n\nnew words", "a")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_emptied(frame(spark, rows)).collect()}
    assert got == {1: "alpha beta gamma\ndelta", 3: "", 4: None, 5: "\nnew words"}


def brute_print(text, k=4):
    w = words_of(lower(text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, bits=4):
    prints = [brute_print(t) for _, t, _ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        r = root(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [(d, prints[i], low[root(i)]) for i, (d, _, _) in enumerate(rows)]


def test_simhash_matches_brute_force(spark):
    rows = awkward(200) + [(300 + i, "base words that repeat in a longer text so that few bits change " * 4 + f"tail{i}", "a") for i in range(90)]
    got = simhash.near_duplicates(frame(spark, rows).withColumn("print", F.lit("x"))).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["print"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_anchors_meet_for_every_pattern():
    import numpy as np

    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, 4, replace=False)) for _ in a], np.uint64)
    b = a ^ flips
    rows_a, keys_a = simhash.anchors(a)
    rows_b, keys_b = simhash.anchors(b)
    met = {(x, k) for x, k in zip(rows_a.tolist(), keys_a.tolist())} & {(x, k) for x, k in zip(rows_b.tolist(), keys_b.tolist())}
    assert {x for x, _ in met} == set(range(len(a)))


def test_simhash_keeps_one_of_each_group(spark):
    rows = awkward(40)
    want = {c for d, _, c in brute_components(rows) if d is not None and d == c}
    got = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want)
    assert sum(r["doc_id"] is None for r in got) == 1


def test_simhash_refuses_more_bits_than_its_anchors_cover(spark):
    prints = spark.createDataFrame([(0,), (31,)], "print long")
    with pytest.raises(ValueError):
        simhash.links(prints, 5)
    assert simhash.links(prints, 4).count() == 0


def test_mix_reaches_targets(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(1, 60), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["tiny"] * 20 + [None] * 200)] + [(None, None, "mid"), (5, "", "mid")]
    docs = frame(spark, rows).withColumn("size", F.lit(-1)).withColumn("copies", F.lit("x"))
    got = source_mix.mix_sources(docs, block_rows=50).collect()
    again = source_mix.mix_sources(docs.repartition(7), block_rows=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    sizes = {}
    for r_ in got:
        assert r_["taken"] == r_["size"] * r_["copies"] and 0 <= r_["copies"] <= 2
        s = sizes.setdefault(r_["source_size"], [0, 0, r_["target"]])
        s[0] += r_["size"]
        s[1] += r_["taken"]
    total = sum(s[0] for s in sizes.values())
    assert abs(sum(s[2] for s in sizes.values()) - 1.5 * total) < 1
    for size, (n, taken, target) in sizes.items():
        assert n == size and target <= 2 * size + 1e-6 and abs(taken - target) <= 130
    weigh = dict(zip(["big", "mid", "tiny", None], [5, 2, 1, 5]))
    own = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in weigh}
    target, room = dict.fromkeys(own, 0.0), 1.5 * sum(own.values())
    while True:  # excess reshared by weight until none is above
        full = {s for s in own if target[s] >= 2 * own[s]}
        level = (room - sum(2 * own[s] for s in full)) / sum(w for s, w in weigh.items() if s not in full)
        target = {s: 2 * own[s] if s in full else level * weigh[s] for s in own}
        if all(target[s] <= 2 * own[s] for s in own):
            break
    assert sorted(round(t, 3) for t in target.values()) == sorted(round(s[2], 3) for s in sizes.values())


def test_mix_emits_copies(spark):
    rows = awkward(80)
    docs = frame(spark, rows)
    mixed = source_mix.mix_sources(docs).agg(F.sum("copies"), F.sum("taken")).first()
    out = source_mix.emit_mix(docs)
    assert out.columns == docs.columns
    assert out.count() == mixed[0]
    assert sum(len(words_of(r["text"] or "")) for r in out.collect()) == mixed[1]
    assert source_mix.emit_mix(frame(spark, [])).count() == 0
    blank = source_mix.mix_sources(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0), (0.0, 0)]


def test_plain_encoding_matches_the_library(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    encoder = piece_dropout.Encoder(pieces, dropout=0.0)
    for t in texts(30) + ["Hello  world", "naïve café 日本語 text!!", "a" * 200]:
        for line in t.split("\n"):
            assert encoder(" " + line).tolist() == model.encode(line), line


def test_dropout_is_lossless_varied_and_repeatable(spark, pieces):
    rows = awkward()
    docs = frame(spark, rows).withColumn("ids", F.lit(1))
    got = piece_dropout.encode_documents(docs, dropout=0.3, seed=7)
    back = piece_dropout.decode_documents(got).collect()
    assert len(back) == len(rows) and all(r["lossless"] in (True, None) for r in back)
    assert sorted((str(r["doc_id"]), str(r["decoded"])) for r in back) == sorted((str(i), str(t)) for i, t, _ in rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, got.repartition(5).collect()))
    assert piece_dropout.encode_documents(frame(spark, [])).count() == 0
    e = piece_dropout.Encoder(pieces, dropout=0.3, seed=1)
    ways = {e("international", str(d)).tobytes() for d in range(50)}
    assert 1 < len(ways) <= piece_dropout.VARIANTS
    all_off = piece_dropout.encode_segment("hello", pieces, 1.0, 3)
    assert len(all_off) == 5


def test_agendas_side_by_side_give_the_same_ids(pieces):
    table = merge_table(pieces)
    segments = sorted({"", "a", " the", "  double", "▁a", "a▁b", "\x00x", "日本語", "naïve", "é" * 30, " " * 40, " internationalization", "ab" * 30}, key=len)[1:]
    for dropout in (0.0, 0.1, 0.6, 1.0):
        keys = [k * 0x9E3779B97F4A7C15 & piece_dropout.MASK for k in range(len(segments))]
        got = piece_dropout.encode_short(segments, keys, pieces, table, dropout)
        for segment, key, ids in zip(segments, keys, got):
            assert np.frombuffer(ids, np.int32).tolist() == piece_dropout.encode_segment(segment, pieces, dropout, key)
    texts = ["one  text\nof words " * 20, "", "x" * 200, "one  text"]
    encoder = piece_dropout.Encoder(pieces, dropout=0.3, seed=1, table=table)
    together = encoder.encode_all(texts, list("abcd"))
    assert [x.tolist() for x in together] == [piece_dropout.Encoder(pieces, dropout=0.3, seed=1)(t, d).tolist() for t, d in zip(texts, "abcd")]
    assert all(len(s) <= piece_dropout.KEPT_CHARS for kept in encoder.kept for s in kept)
    slices = list(piece_dropout._batches(["a" * 400_000, None, "b" * 200_000, "", "c"]))
    assert [(s.start, s.stop) for s in slices] == [(0, 3), (3, 5)] and list(piece_dropout._batches([])) == []


def test_dropout_is_drawn_for_each_occurrence(pieces):
    encoder = piece_dropout.Encoder(pieces, dropout=0.3, seed=1)
    long = "internationalization" * 4
    for word in (" international", " " + long):
        ways = {x.tobytes() for x in encoder.encode_all([word] * 300, [str(d) for d in range(300)])}
        inside = {x.tobytes() for x in encoder.encode_all([word] * 300, ["a"] * 300)}
        assert len(ways) > 20 and len(inside) == 1
    texts = [" international" * 400, " naïve é▁x 日本語 the the of" * 40 + long, "", "one\ntwo"]
    for text, document in [*zip(texts, "abcd"), *zip(texts, "efgh")]:
        segments = piece_dropout.SEGMENT.findall(text)
        keys = piece_dropout.occurrence_keys(xxhash.xxh64_intdigest(f"1:{document}"), len(segments)).tolist()
        split = [piece_dropout.encode_segment(s, pieces, 0.3, k) for s, k in zip(segments, keys)]
        assert encoder(text, document).tolist() == sum(split, [])
        if text == texts[0]:
            assert len(set(map(tuple, split))) > 20 and split[:128] != split[128:256]


def brute_count(word, pieces, unknown):
    best = [(0.0, 0)]
    for i in range(len(word)):
        ways = [(best[j][0] + pieces.scores[word[j : i + 1]], -(-best[j][1] + 1)) for j in range(i + 1) if word[j : i + 1] in pieces.scores]
        ways = [(s, n) for s, n in ways]
        if word[i] not in pieces.scores:
            ways.append((best[i][0] + unknown, best[i][1] - len(word[i].encode())))
        best.append(max(ways))
    return -best[-1][1]


def test_only_pieces_that_end_at_a_character_are_met(pieces):
    scores = {p: -1.0 - i / 7 for i, p in enumerate(["a", "ab", "abcd", "bc", "bcx", "c", "cd", "\U0001f600", "x\u2581"])}
    ends = trie_counts.endings(scores)
    for word in ("abcdbcxabcd", "zzabczbcx", "", "\U0001f600ab\ud800c", "x\u2581\u2581x\u2581a"):
        state = 0
        for i, c in enumerate(word):
            while (to := ends.step.get(state << 21 | ord(c))) is None and state:
                state = ends.shorter[state]
            state = to or 0
            there = sorted((i + 1 - j, scores[word[j : i + 1]]) for j in range(i + 1) if word[j : i + 1] in scores)
            assert sorted(ends.pieces[state]) == there
    # a new node costs as many steps as pieces end there, not as the longest piece has characters
    ends, met = trie_counts.endings(trie_counts.unigram(pieces).scores), []
    trie = trie_counts.UnigramTrie(ends)
    trie.ends = dataclasses.replace(ends, pieces=type("Counted", (), {"__getitem__": lambda _, s: met.append(len(ends.pieces[s])) or ends.pieces[s]})())
    for word in ("international", "zqxjkvzqxjkv", "internationally"):
        assert trie.count(" " + word) == brute_count(SPACE + word, trie_counts.unigram(pieces), ends.unknown)
    assert len(met) == 14 + 12 + 2 == len(trie.score) - 1 and sum(met) < len(met) * pieces.longest / 3


def test_token_counts_match_brute_force(spark, pieces, monkeypatch):
    ranked = sorted(pieces.ids, key=lambda p: (-pieces.scores[p], pieces.ids[p]))
    whole = sum(1 / n for n in range(1, len(ranked) + 1))
    ranks = pieces.scores
    pieces = trie_counts.unigram(pieces)
    assert math.isclose(sum(math.exp(s) for s in pieces.scores.values()), 1)
    assert all(math.isclose(math.exp(pieces.scores[p]), 1 / (n * whole)) for n, p in list(enumerate(ranked, 1))[::97]) and ranks != pieces.scores
    unknown = min(pieces.scores.values()) - 10
    rows = awkward()
    got = trie_counts.count_tokens(frame(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        words = trie_counts.PRE_TOKEN.findall(t or "")
        want.append((str(i), len(words), sum(brute_count(w.replace(" ", SPACE), pieces, unknown) for w in words)))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted(want)
    monkeypatch.setattr(trie_counts, "MAX_NODES", 20)  # a bounded trie gives the same counts
    monkeypatch.setattr(trie_counts, "TRIE_CHARS", 3)
    small, big = trie_counts.UnigramTrie(pieces), trie_counts.UnigramTrie(pieces)
    for w in {w for _, t, _ in rows for w in trie_counts.PRE_TOKEN.findall(t or "")}:
        assert small.count(w) == brute_count(w.replace(" ", SPACE), pieces, unknown) == big.count(w)
    assert trie_counts.count_tokens(frame(spark, [])).count() == 0
    clashing = frame(spark, rows).withColumn("n_tokens", F.lit("x")).withColumn("score", F.lit(1))
    assert sorted((str(r[0]), r[1], r[2]) for r in trie_counts.count_tokens(clashing).collect()) == sorted(want)


def test_new_words_are_scored_as_arrays(pieces, monkeypatch):
    pieces = trie_counts.unigram(pieces)
    ends = trie_counts.endings(pieces.scores)
    r = random.Random(5)
    letters = "aeinorst" * 9 + "\u2581\x00\u00e9\u65e5\u672c\U0001f600-9"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 12))) for _ in range(40)) for _ in range(60)]
    texts += ["international\tinternationally  internation", None, "", " \n ", "z" * 70 + " " + "z" * 63, texts[0]]
    split = [trie_counts.PRE_TOKEN.findall(t or "") for t in texts]
    unknown = min(pieces.scores.values()) - 10
    want = [sum(brute_count(w.replace(" ", SPACE), pieces, unknown) for w in words) for words in split]
    stepped = []
    step = trie_counts.UnigramTrie.step
    monkeypatch.setattr(trie_counts.UnigramTrie, "step", lambda self, c, *a: stepped.append(c) or step(self, c, *a))
    assert trie_counts.WordCounts(ends).documents(texts) == ([len(w) for w in split], want)
    assert len(stepped) == 70  # only the word over TRIE_CHARS goes through a node at a time
    monkeypatch.setattr(trie_counts, "FEW_WORDS", 1)
    for most, rows, chars in ((10, 7, 50), (300, 1, 1), (400_000, 1 << 15, 1 << 22)):
        for name, value in (("MAX_WORDS", most), ("ROWS", rows), ("SLICE_CHARS", chars)):
            monkeypatch.setattr(trie_counts, name, value)
        counts, got = trie_counts.WordCounts(ends), []
        for run in trie_counts._slices(texts):
            got += counts.documents(run)[1]
        assert got == want
    odd = sorted({"\ud800a", "a\udfff\ud800", "\uffff", "\x7f\x80", "\u07ff\u0800", "\U0010ffff" * 3})
    assert trie_counts.WordCounts(ends).sorted_counts(odd).tolist() == [trie_counts.UnigramTrie(ends).count(w) for w in odd]


def test_held_out_rows_follow_crc32(spark):
    from tessera.llm import byte_cnn

    got = spark.range(50).select("id", byte_cnn.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
