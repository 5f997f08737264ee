import random

import numpy as np

from sagebrook.llm import neardup
from sagebrook.llm.neardup import CONTENT, TITLE, Measure, all_pairs, close_pairs, groups, near_duplicates, normal, pieces


def brute(texts, m, number=False):
    out, s = set(), {k: pieces(normal(t), m.piece) for k, t in texts.items() if t is not None and len(t) >= m.shortest}
    keys = sorted(s, key=int) if number else sorted(s)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            union = len(s[a] | s[b])
            if union and len(s[a] & s[b]) >= m.threshold * union - 1e-9:
                out.add((a, b))
    return out


def corpus(n, words, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghıklmnoöprsştuvyz") for _ in range(r.randint(3, 9))) for _ in range(900)]
    texts = {}
    for i in range(n):
        if i % 3 and texts:
            base = texts[r.choice(list(texts))].split(" ")
            for _ in range(r.randint(0, len(base) // 4)):
                k = r.randrange(len(base))
                base[k : k + 1] = r.choice(([], [r.choice(vocab)], [base[k], r.choice(vocab)]))
            texts[str(i)] = " ".join(base)
        else:
            texts[str(i)] = " ".join(r.choice(vocab) for _ in range(r.randint(*words)))
    return texts


def found(spark, texts, m, number=False):
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    return {(r["id_a"], r["id_b"]) for r in all_pairs(*near_duplicates(df, m, number), number).collect()}


def test_contents_against_brute_force(spark):
    texts = corpus(240, (45, 140), 1)
    want, got = brute(texts, CONTENT), found(spark, texts, CONTENT)
    assert not got - want
    assert len(want) > 60 and len(want - got) <= 0.005 * len(want)


def test_titles_against_brute_force(spark):
    texts = corpus(240, (3, 9), 2)
    want, got = brute(texts, TITLE, True), found(spark, texts, TITLE, True)
    assert not got - want
    assert len(want) > 60 and len(want - got) <= 0.005 * len(want)


def test_copies_and_edges(spark):
    text = " ".join(corpus(1, (60, 61), 3)["0"].split())
    texts = {f"{i:02}": text.replace(" ", "\n ") if i % 2 else text for i in range(12)} | {"n": None, "e": "", "s": "short", "x": text[:150] + " " + text[:60]}
    assert found(spark, texts, CONTENT) == brute(texts, CONTENT)
    assert found(spark, {"1": None}, CONTENT) == set()
    assert found(spark, {"1": "", "2": "ab", "3": "ab"}, TITLE) == set()


def test_every_pair_of_many_equal_texts(spark, monkeypatch):
    """A class of any size is expanded, in groups, and linked to others with all its members."""
    text = " ".join(corpus(1, (60, 61), 3)["0"].split())
    near = text[:-12] + " something"
    texts = {f"{i:03}": text for i in range(102)} | {"x": near, "y": near}
    for equal in (neardup.EQUAL, 16):
        monkeypatch.setattr(neardup, "EQUAL", equal)
        df = spark.createDataFrame(list(texts.items()), "id string, text string")
        got = [(r["id_a"], r["id_b"]) for r in all_pairs(*near_duplicates(df, CONTENT)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(texts, CONTENT)
        assert sum(a < "x" and b < "x" for a, b in got) == 5151


def test_texts_of_many_partners_are_dealt(spark, monkeypatch):
    texts = corpus(120, (45, 60), 6)
    want = found(spark, texts, CONTENT)
    monkeypatch.setattr(neardup, "PARTNERS", 2)
    assert found(spark, texts, CONTENT) == want and want


def test_groups_are_components_of_links(spark):
    texts = corpus(150, (45, 90), 7) | {"900": None}
    texts |= {"901": texts["0"]}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    parts = near_duplicates(df, CONTENT, True)
    got = {r["id"]: r for r in groups(*parts, True).collect()}
    root = {k: k for k in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in all_pairs(*parts, True).collect():
        x, y = sorted((find(a), find(b)), key=int)
        root[y] = x
    assert {k: r["group_id"] for k, r in got.items()} == {k: find(k) for k in got}
    assert got["901"]["class_id"] == "0" and got["901"]["n_links"] == got["0"]["n_links"] and "900" not in got
    assert sum(r["n_links"] for k, r in got.items() if k == r["class_id"]) == 2 * parts[0].count()
    nothing = near_duplicates(df.limit(0), CONTENT)
    assert groups(*nothing).count() == 0 and all_pairs(*nothing).count() == 0


def test_large_blocks_are_split_without_loss(spark, monkeypatch):
    texts = {k: v for k, v in corpus(150, (45, 60), 4).items()}
    want = found(spark, texts, CONTENT)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SAMPLED", 1)
    assert found(spark, texts, CONTENT) == want


def test_tiles_skip_nothing_within_the_radius():
    """Texts of all lengths: tiles beyond the radius of populations are skipped, and no similar pair is lost by it."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdefghij ") for _ in range(int(200 * 1.002**i))) for i in range(1500)]
    texts = base + [t[: len(t) * 4 // 5] for t in base]
    prints, _, pops = neardup.signatures(texts, CONTENT)
    assert [len(pieces(t, 5)) for t in texts] == pops.tolist()
    x, y, skipped = close_pairs(prints, pops, CONTENT)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    a, b = np.nonzero(np.triu(far <= CONTENT.radius, 1))
    near = {(i, j) for i, j in zip(a.tolist(), b.tolist()) if min(pops[i], pops[j]) + 1 >= 0.6 * max(pops[i], pops[j])}
    assert got == near and {(i, i + 1500) for i in range(1500)} <= got
    assert skipped >= 1


def test_radius_passes_the_threshold():
    assert Measure(5, 0.6).radius > 51 + 4 * 6
