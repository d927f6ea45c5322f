"""Duplicates, near-duplicates, encodings, tokens, packing and abuse scores on small tables."""

from __future__ import annotations

import base64
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import abuse, duplicates, encoding_repair, near_duplicates, packing, tokenize

# ---- formatting duplicates -----------------------------------------------------------------------

MESSAGES = [
    (1, "E", "Row count differs: expected=5, actual=-3, ratio=2.5"),
    (2, "e", "  ROW\tcount differs — [ratio=2.5] [Actual=-3] [EXPECTED=5] !!"),
    (3, "<E>", 'Row count differs {"actual": -3, "expected": 5, "ratio": "2.5"}'),
    (4, "E", "Row count differs: expected=-3, actual=5, ratio=2.5"),
    (5, "E", "Row count differs: expected=5, actual=3, ratio=2.5"),
    (6, "E", "Row count differs: expected=5, actual=-3, ratio=25"),
    (7, None, "Row count differs: expected=5, actual=-3, ratio=2.5"),
    (8, None, "row count differs (expected : 5 / actual : −3 / ratio : 2.5)"),
    (9, "", "Row count differs: expected=5, actual=-3, ratio=2.5"),
    (10, "E", "count row differs: expected=5, actual=-3, ratio=2.5"),
    (11, "E", None), (12, "E", None), (13, "E", ""), (14, "E", " !? "),
    (15, "E", "a=1, a=1, b=2"), (16, "E", "a=1, b=2, b=2"), (17, "E", "b=2; a=1; a=1"),
    (18, "E", "a=1, b=2"), (19, "E", "lane 3-5 done"), (20, "E", "lane 3 -5 done"),
]


def test_copies(spark):
    df = spark.createDataFrame(MESSAGES, "rowId long, errorType string, message string").withColumns({c: F.lit("x") for c in ("row_id", "et", "fields", "k1", "n")})
    got = {(r.first_row_id, r.copy_row_id) for r in duplicates.copies(df).collect()}
    assert got == {(1, 2), (1, 3), (7, 8), (11, 12), (13, 14), (15, 17)}
    records = {r.first_row_id: r.n_copies for r in duplicates.records(df).collect()}
    assert records[1] == 3 and sum(records.values()) == len(MESSAGES)
    assert duplicates.copies(df.limit(0)).count() == 0


def test_collisions_are_told_apart(spark, monkeypatch):
    """With a fingerprint that is the same for all rows, the comparison of contents must do all the work."""
    monkeypatch.setattr(duplicates, "fingerprint", lambda rows: rows.withColumns({"k1": F.lit(0), "k2": F.lit(0)}))
    df = spark.createDataFrame(MESSAGES, "rowId long, errorType string, message string")
    got = {(r.first_row_id, r.copy_row_id) for r in duplicates.copies(df).collect()}
    assert got == {(1, 2), (1, 3), (7, 8), (11, 12), (13, 14), (15, 17)}


# ---- near-duplicates -----------------------------------------------------------------------------


def words(t):
    return set(re.findall(r"[a-z0-9]+", t.lower()))


def test_word_sets_against_a_pattern():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["", "abc", "abc", "x" * 300, "é1é2", *("".join(rng.choice("ab1_ -é\n") for _ in range(rng.randint(0, 60))) for _ in range(300))]
    row, h = near_duplicates.word_sets(pa.array(texts))
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(words(t)) for t in texts]
    by = {}
    for i, t in enumerate(texts):
        key = frozenset(h[row == i].tolist())
        assert by.setdefault(key, words(t)) == words(t)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = ["at", "in", "line", "file", "java"]
    texts = []
    for _ in range(60):
        base = rng.sample(vocabulary, rng.randint(20, 90)) + common
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            new = list(base)
            for _ in range(rng.randint(0, len(base) // 5)):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rng.shuffle(new)
            texts.append(" ".join(new))
    texts += [texts[0].upper(), texts[0], "", None, "!!", "one", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumns({"text": F.lit(1), "row_id": F.lit(2), "c1": F.lit(3)})
    near = near_duplicates.NearDuplicates(df, "id", "body", 0.7)
    sets = [words(t or "") for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    got = [(r.row_id_a, r.row_id_b) for r in near.row_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    member = {r.row_id: r for r in near.memberships().collect()}
    assert member[0].n_copies == sum(s == sets[0] for s in sets) and len(member) == sum(bool(s) for s in sets)
    classes = {min(k for k in range(len(sets)) if sets[k] == sets[i]) for i in range(len(sets)) if sets[i]}
    first = lambda i: min(k for k in range(len(sets)) if sets[k] == sets[i])
    links = {frozenset((first(i), first(j))) for i, j in want}
    for c in classes:
        assert member[c].class_id == c and member[c].n_links == len({x for x in links if c in x and len(x) == 2})
    assert near_duplicates.NearDuplicates(df.limit(0), "id", "body", 0.7).row_pairs().count() == 0


def test_hot_copies_and_families_keep_their_links(spark):
    """A third of the rows are copies of one text, another part one family of small edits; nothing is lost."""
    rng = random.Random(6)
    base = [f"h{i}" for i in range(60)]
    texts = [" ".join(base)] * 400 + [" ".join(base[:57] + ["x", "y"])] * 3
    family = [f"f{i}" for i in range(50)]
    texts += [" ".join([*family, f"id{i}", f"no{i}"]) for i in range(25)]
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(6)
    near = near_duplicates.NearDuplicates(df, "id", "body", 0.7)
    member = {r.row_id: (r.class_id, r.n_copies, r.n_links) for r in near.memberships().collect()}
    assert member[7] == (0, 400, 1) and member[401] == (400, 3, 1)
    assert all(member[i] == (i, 1, 24) for i in range(403, 428)) and all(member[i][2] == 0 for i in range(428, len(texts)))
    assert near.pairs.count() == 1 + 25 * 24 // 2


def test_crowded_keys_are_split_and_keep_their_links(spark):
    """With a low bound every family's keys are dealt out over blocks; the pairs stay the same."""
    rng = random.Random(9)
    texts = []
    for f in range(3):
        family = [f"f{f}w{i}" for i in range(50)]
        texts += [" ".join([*family, *(f"v{rng.randrange(10**6)}" for _ in range(rng.randint(1, 9)))]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(3)
    sets = [words(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    near = near_duplicates.NearDuplicates(df, "id", "body", 0.7, busy=16, crowd=32)
    got = [(r.row_id_a, r.row_id_b) for r in near.row_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30_000


def test_signatures_never_rule_out_a_pair():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 900, rng.integers(1, 400))).astype("<u8") * np.uint64(77_777_777_777) % np.uint64(1 << 40) for _ in range(60)]
    blobs = pa.array([np.unique(r).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for r in rows], pa.binary())
    s = near_duplicates._Sets(blobs)
    common = np.unique(rows[0])[:500]
    sign = near_duplicates.signatures(s, common)
    for i, j in itertools.combinations(range(60), 2):
        shared = len(np.intersect1d(rows[i], rows[j]))
        bound = int(np.bitwise_count(sign[i, :-1] & sign[j, :-1]).sum()) + min(int(sign[i, -1]), int(sign[j, -1]))
        assert shared <= bound


def test_families_above_the_common_share_keep_their_links(spark):
    """A third of all sets is one family; its own words make up 15 to 25 of 145 to 155 in a row, so all links lie in common words."""
    rng = random.Random(8)
    family = [f"f{i}" for i in range(130)]
    sets = [{*family, *(f"own{i}x{k}" for k in range(15 + i % 11))} for i in range(300)]
    sets += [{f"r{rng.randrange(10**6)}" for _ in range(100)} for _ in range(600)]
    df = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(sets)], "id long, body string").repartition(6)
    near = near_duplicates.NearDuplicates(df, "id", "body", 0.7)
    got = {(r.row_id_a, r.row_id_b) for r in near.row_pairs().collect()}
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if 130 >= 0.7 * (len(sets[i]) + len(sets[j]) - 130)}
    assert len(want) > 40_000 and got == want


def _rows_of_one_vocabulary(rng, n):
    """Word sets that share most of their common words by chance, some 24 % of their words being rare."""
    common, rare = [f"c{i}" for i in range(190)], [f"n{i}" for i in range(1500)]
    return [{*rng.sample(common, rng.randint(130, 150)), *rng.sample(rare, rng.randint(40, 50))} for _ in range(n)]


def test_unlike_rows_of_one_vocabulary_seldom_share_a_key():
    """Rows that share a key are compared, which would be quadratic if keys were held by a fixed part of all rows."""
    import pyarrow as pa

    sets = _rows_of_one_vocabulary(random.Random(12), 1500)
    row, h = near_duplicates.word_sets(pa.array([" ".join(sorted(x)) for x in sets]))
    h = h >> np.uint64(64 - 8 * near_duplicates.WORD_BYTES)
    s = near_duplicates._Sets(pa.array([near_duplicates._bytes(h[row == i].view(np.int64), near_duplicates.WORD_BYTES) for i in range(len(sets))], pa.binary()))
    w, n = np.unique(s.words, return_counts=True)
    none = np.zeros(0, np.int64)
    plan = near_duplicates.Plan(w[n > 0.2 * len(sets)], none.view(np.uint64), none, 0.7)
    keys = np.concatenate([key.ravel() for close, _, key, _ in near_duplicates._entries(s, plan) if close])
    held = np.unique(keys, return_counts=True)[1]
    assert (held * (held - 1)).sum() < 0.6 * len(sets) * (len(sets) - 1)


def test_keys_of_rare_and_common_words_miss_no_division_of_the_differences():
    """What the schedule promises, worked out for pairs of every share, division and size, by what each row can know."""
    for t in (0.6, 0.7, 0.85):
        mixes, needed = near_duplicates.schedule(t)
        none = np.zeros(0, np.int64)
        rng = np.random.default_rng(5)
        assert (np.diff(needed, axis=0) <= 0).all()
        for below in (0.0, 0.15):
            plan = near_duplicates.Plan(none.view(np.uint64), none.view(np.uint64), none, t, below=below)
            worst, tried = 0.0, 0
            for _ in range(15_000):
                rare = rng.random() * 0.8
                lost = rng.dirichlet([0.3] * 4) * (1 / t - 1) * rng.uniform(0.9, 1)
                p, q = np.array([rare, 1 - rare]), lost[:2]
                one, two = p + q, p + lost[2:]
                if p.sum() < t * (one.sum() + two.sum() - p.sum()):
                    continue
                share = np.array([one[0] / one.sum(), two[0] / two.sum()])
                s_rare, s_common = p / np.maximum(one + two - p, 1e-12)
                if (share >= near_duplicates._fingerprinted(t)).all() and s_rare >= near_duplicates.LEAST_RARE or (share < below).any():
                    continue
                if (share >= (1 - t) / (1 - near_duplicates.LEAST_RARE)).any():
                    assert s_rare >= near_duplicates.LEAST_RARE - 1e-9 and (share >= near_duplicates._fingerprinted(t)).all()
                    continue
                keys = needed[np.floor(near_duplicates._least_pair(share, plan) * near_duplicates.SHARES).astype(int)].min(axis=0)
                worst = max(worst, np.prod([(1 - near_duplicates.group_chance(s_rare, s_common, a, b)) ** n for (a, b), n in zip(mixes, keys) if n]))
                tried += 1
            assert tried > 150 and worst <= near_duplicates.MISS


def test_pairs_of_one_vocabulary_are_all_found(spark):
    """Differences in rare words, in common ones and in both, and rows with hardly any rare word; the rest shares the vocabulary."""
    rng = random.Random(13)
    sets = _rows_of_one_vocabulary(rng, 1200)
    for i in range(240):
        own = sorted(sets[i])
        rare, common = [w for w in own if w[0] == "n"], [w for w in own if w[0] == "c"]
        lost = {*rng.sample(rare, min(len(rare), 28))} if i % 3 == 0 else {*rng.sample(common, 28)} if i % 3 == 1 else {*rng.sample(own, 30)}
        sets.append({*own} - lost | ({f"n{rng.randrange(1500)}" for _ in range(26)} if i % 3 == 0 else {f"c{rng.randrange(190)}" for _ in range(14)}))
        if i % 8 == 0:
            sets += [{*common, *rare[: i % 5]}, {*common, *rare[:3]} - {*common[:5]}]
    df = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(sets)], "id long, body string").repartition(4)
    near = near_duplicates.NearDuplicates(df, "id", "body", 0.7, common=0.1)
    got = {(r.row_id_a, r.row_id_b) for r in near.row_pairs().collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    assert len(want) > 300 and got == want


# ---- encodings -----------------------------------------------------------------------------------

CLEAN = [
    "Größe des Puffers: {}", "naïve Suche über {} Einträge", "Désolé, l’accès à {} échoue", "La conexión {} se cerró después", "Überlauf beim Zählen von {}", "élève numéro {} déjà là",
    "Ошибка проверки строки {}", "журнал сборки {} повреждён", "接続がタイムアウトしました {}", "cañón señal {} niño", "preço não é {} válido",
]


def test_mojibake_is_found_and_restored(spark):
    rows, want, truth = [], set(), {}
    for i, (t, n) in enumerate((t, n) for t in CLEAN for n in range(12)):
        s = t.format(f"x{n}")
        if n in (9, 10, 11):
            for w, r in {9: [("utf-8", "cp1252")], 10: [("utf-8", "mac_roman")], 11: [("utf-8", "latin-1"), ("utf-8", "latin-1")]}[n]:
                s = encoding_repair.garble(s, w, r)
            want.add((i, "message"))
            truth[i] = t.format(f"x{n}")
        rows.append((i, s, None))
    rows += [(900, "ATENÇÃO: CONEXÃO", "ok ✓ ├── a\n– “q” … €"), (901, None, None), (902, "", "ascii"), (903, "lost �� here", None), (904, "fine", "Größe des Puffers: x1\nGrÃ¶ÃŸe des Puffers: x2")]
    want |= {(903, "message"), (904, "stdout")}
    df = spark.createDataFrame(rows, "rowId long, message string, stdout string").withColumns({c: F.lit(0) for c in ("form", "n", "text", "row_id", "field_name")})
    r = encoding_repair.Repair(df)
    assert {(x.row_id, x.field_name) for x in r.found().collect()} == want
    text = {(x.row_id, x.field_name): x.restored_text for x in r.restored().collect()}
    assert text[904, "stdout"] == "Größe des Puffers: x1\nGröße des Puffers: x2" and text[903, "message"] is None
    right = sum(text[i, "message"] == t for i, t in truth.items())
    assert right >= 0.9 * len(truth)
    assert encoding_repair.Repair(df.limit(0)).found().count() == 0


# ---- tokens --------------------------------------------------------------------------------------

ODD = ["", " ", "\n\n  x", "don't CAN'T we'll", "a" * 3000, "😀🏽 naïve  日本語", "<|endoftext|>", "\x00\x01", "ab" * 700 + " " * 300, "1234567890 12.5e-3", "tab\tand\r\nlines  \n", "é" * 40]


def test_encoding_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdehtn  .,'’éß日\n0") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").withColumns({"ids": F.lit("x"), "n_tokens": F.lit(1)})
    got = {r.doc_id: r.ids for r in tokenize.encode(df, block_chars=500).collect()}
    assert got[999] == [] and all(got[i] == lib.encode_ordinary(t) for i, t in enumerate(texts))
    assert {r.doc_id: r.n_tokens for r in tokenize.sizes(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokenize.encode(df.limit(0)).count() == 0


def test_each_piece_is_replayed_once(monkeypatch):
    """Rows of one piece from many blocks, in parts of the index as small as can be."""
    import pyarrow as pa

    data = tokenize.vocabulary(tokenize.TOKENIZER_DIR, "byte_bpe_50k")
    table = tokenize.merge_table(data)
    seen = []
    real = tokenize.replay
    monkeypatch.setattr(tokenize, "replay", lambda pieces, t: seen.extend(pieces) or real(pieces, t))
    rows = [(b, a, w) for w in sorted(["one", " two", "three", "x" * 70]) for b, a in ((1, 0), (2, 5), (3, 1))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 5])], ["block", "at", "piece"]) for i in range(0, len(rows), 5)]
    for size in (1, 10**6):
        seen.clear()
        out = [r for b in tokenize._replayed(iter(batches), table, size, False) for r in b.to_pylist()]
        assert len(out) == len(rows) and sorted(seen) == sorted({w.encode() for _, _, w in rows})
        by = {(b, a, w): r["ids"] for (b, a, w), r in zip(rows, out)}
        assert all(np.frombuffer(x, np.int32).tolist() == real([w.encode()], table)[0] for (_, _, w), x in by.items())


# ---- packing -------------------------------------------------------------------------------------


def check_packing(rows, sizes, capacity):
    pieces, boxes = {}, {}
    for r in rows:
        assert 0 <= r.n_tokens <= capacity and r.start_token == r.piece_no * capacity
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
        boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
    assert set(pieces) == set(sizes) and max(boxes.values(), default=0) <= capacity
    for d, p in pieces.items():
        assert [k for k, _ in sorted(p)] == list(range(len(p))) and sum(n for _, n in p) == sizes[d]
        assert len(p) == max(1, -(-sizes[d] // capacity))
    return sum(v > 0 for v in boxes.values())


def first_fit(sizes, capacity):
    """Containers that first-fit-decreasing takes."""
    free = []
    for s in sorted((p for s in sizes for p in [capacity] * (s // capacity) + [s % capacity] if p), reverse=True):
        i = next((i for i, f in enumerate(free) if f >= s), None)
        if i is None:
            free.append(capacity - s)
        else:
            free[i] -= s
    return len(free)


@pytest.mark.parametrize("kind", ["short", "equal", "mixed", "hot"])
def test_packing(spark, kind):
    rng = random.Random(8)
    draw = {"short": lambda: rng.randint(1, 60), "equal": lambda: 30, "mixed": lambda: int(min(900, rng.lognormvariate(4, 1.2))) + 1, "hot": lambda: rng.choice([17, 17, 17, rng.randint(1, 200)])}[kind]
    sizes = {i: draw() for i in range(2000)} | {5000: 0, 5001: 64 * 3 + 1}
    df = spark.createDataFrame([*sizes.items(), ], "doc_id long, n_tokens int").repartition(3).withColumns({"size": F.lit(1), "part": F.lit(2), "rank": F.lit(3)})
    out = packing.pack(df, {1: 64, 2: 512})
    total = sum(sizes.values())
    for target, capacity in ((1, 64), (2, 512)):
        n = check_packing(out.where(f"target_id = {target}").collect(), sizes, capacity)
        assert -(-total // capacity) <= n <= first_fit(sizes.values(), capacity) * 1.01 + 2
    report = packing.report(out, {1: 64, 2: 512}).orderBy("target_id").collect()
    assert report[0].n_tokens == total and report[0].fullest <= 64


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, n_tokens int")
    assert [(r.container_id, r.n_tokens) for r in packing.pack(df, {1: 8}).collect()] == [(0, 0), (0, 0)]
    assert packing.pack(df.limit(0), {1: 8}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {1: 0})
    slots, n = packing.plan({}, 10)
    assert slots == [] and n == 0


def test_windows_of_odd_capacities():
    """The window stays small and wastes little of the container, whatever the capacity's factors."""
    counts = {k: 10 for k in range(1, 1200)}
    for capacity in (4096, 4095, 4093, 131071, 100_003, 65_537):
        w = packing.window_of(counts, capacity)
        assert 32 <= w <= packing.MAX_WINDOW and capacity % w <= 8
    assert packing.window_of({5: 3}, 40) == 40
    slots, n = packing.plan(counts, 131071)
    total = sum(k * c for k, c in counts.items())
    assert -(-total // 131071) <= n <= -(-total // 131071) + 1


def test_combinations_are_complete():
    lengths = np.array([1, 2, 3, 5, 8, 9])
    got = {tuple(sorted(int(lengths[i]) for i in c if i >= 0)) for c in packing.combinations(lengths, 10)}
    want = {tuple(sorted(c)) for k in (1, 2, 3) for c in itertools.combinations_with_replacement(lengths.tolist(), k) if sum(c) == 10}
    assert got == want
    x = packing.nnls(packing.combinations(lengths, 10), np.array([4.0, 4, 2, 2, 4, 4]), np.ones(6), 2000)
    assert (x >= 0).all()


# ---- abuse ---------------------------------------------------------------------------------------


def corpus(n, seed):
    rng = random.Random(seed)
    names, parts = ["reed", "wren", "kite", "moss"], ["vault", "queue", "parser", "index"]
    groups = ["refugees", "women", "muslims", "germans", "gays"]
    clean = ["The {p} test fails on arm64.", "Thanks {n}, you were right.", "We hired {g} for the {p} team.", "The stupid {p} is slow.", "{g} in this office remember the first {p}.", "Kill the child process of the {p}.", "Please rerun the {p}, {n}."]
    bad = ["{n}, you are a worthless idiot.", "I will find you and break your legs, {n}.", "{g} are vermin and should be thrown out.", "Send me your nudes, {n}."]
    out = []
    for i in range(n):
        pick = lambda ts: rng.choice(ts).format(n=rng.choice(names), p=rng.choice(parts), g=rng.choice(groups))
        lines = [pick(clean) for _ in range(rng.randint(1, 6))]
        y = int(rng.random() < 0.15)
        if y:
            s = pick(bad)
            lines.insert(rng.randint(0, len(lines)), rng.choice([s, s.upper(), s.replace("i", "1"), s.replace("o", "о")]))
        out.append((i, "\n".join(lines), f"s{i % 3}", y))
    return out


def test_abuse_held_out(spark):
    docs = corpus(900, 1)
    extra = [(9000, None, "s0", None), (9001, "", "s0", None), (9002, "  \n ", None, None)]
    df = spark.createDataFrame([d[:3] for d in docs + extra], "doc_id long, text string, source string").withColumns({"score": F.lit("x"), "y": F.lit(1)})
    labels = spark.createDataFrame([(d[0], f"r{k}", d[3] if d[0] % 7 else None) for d in docs[:600] for k in (0, 1)], "doc_id long, reviewer string, verdict int")
    c = abuse.AbuseClassifier(df, labels)
    rows = {r.doc_id: r for r in c.scores().collect()}
    held = [d for d in docs[600:]]
    hit = sum(rows[d[0]].flagged and d[3] for d in held)
    said, true = sum(rows[d[0]].flagged for d in held), sum(d[3] for d in held)
    assert hit >= 0.9 * true and hit >= 0.9 * said
    assert all(rows[i].score == 0 and not rows[i].flagged for i in (9000, 9001, 9002))
    rates = {r.source: r.n_docs for r in c.rates().collect()}
    assert sum(rates.values()) == 903
    # naming a group changes nothing that matters
    s = [c.model.score(abuse.normalise(f"We hired {g} for the vault team.")) for g in ("refugees", "women", "christians", "turks")]
    assert max(s) < c.model.threshold
    none = abuse.AbuseClassifier(df, labels.where("verdict = 9"))
    assert none.scores().where("flagged").count() == 0 and none.scores().count() == 903


def test_disguises():
    n = abuse.normalise
    assert n("wоrthless ІDIOT") == n("worthless idiot") and "idiot" in n("1d1ot") and n("i.d.i.o.t now") == "idiot now" and n("soooo") == "so"
    assert n("see job_12 and 0x00ff at 2031") == "see # and # at #"
    assert len(abuse.swaps("women are here")) == 3 and abuse.swaps("nobody is here") == []
