import random

import pytest

from tallyloom.llm.leakage import Passages, leaked_passages
from tallyloom.llm.textnorm import Words, near, plain_word

VOCAB = [a + b + c for a in "ba mo ti ru".split() for b in "lan ver sok".split() for c in "da mi pus".split()]


def item(r, n=40):
    return " ".join(r.choice(VOCAB) + r.choice(["x", "q", "w"]) for _ in range(n))


def test_words_keep_offsets():
    text = "Hé​llo, Wоrld &quot;ＡＢＣ１&quot; <b>col­our</b> reo-\n  rdered labelled\nAgent: RÃ©sumÃ© 12"
    keys, starts, ends = Words()(text)
    assert keys == [Words()(w)[0][0] for w in ["hello", "world", "abc1", "color", "reordered", "labeled", "resume", "12"]]
    assert [text[a:b] for a, b in zip(starts, ends)][:2] == ["Hé​llo", "Wоrld"]


def test_near():
    assert near("kettles", "ketles") and near("kettles", "ketltes") and near("coper", "copper") and near("sat", "sta")
    assert not near("kettles", "kitties") and not near("123", "124") and not near("a", "b") and not near("tin", "tinned")
    assert plain_word("Straße") == "strasse"


@pytest.mark.parametrize("length", [8, 11, 12, 13, 20, 40])
def test_length_decides(length):
    r = random.Random(length)
    for k in range(30):
        text = item(r)
        words = text.split()
        a = r.randrange(0, len(words) - length + 1)
        doc = "unrelated opening words here. " + "\t".join(words[a : a + length]).upper() + ". And some more that follows it today"
        found = Passages([(7, text)]).find(doc)
        assert bool(found) == (length >= 12), (k, length)
        if found:
            i, s, e, n, edits = found[0]
            assert (i, n, edits) == (7, length, 0)
            assert doc[s:e].split("\t") == [w.upper() for w in words[a : a + length]]


@pytest.mark.parametrize(("length", "edits"), [(16, 1), (16, 2), (24, 3), (40, 5), (16, 4), (40, 8)])
def test_edits_within_one_in_eight(length, edits):
    r = random.Random(length * edits)
    allowed = edits * 8 <= length
    for _ in range(30):
        text = item(r, length)
        words: list = text.split()
        # Edits spread so that no shorter part is clean enough on its own.
        gap = (length - 1) / (edits + 1)
        for e in range(edits):
            p = int(round(gap * (e + 1)))
            words[p] = r.choice([["zzzz" + str(e)], [], [words[p], "zzzz"]]) if allowed else ["zzzz" + str(e)]
        flat = [w for x in words for w in (x if isinstance(x, list) else [x])]
        assert bool(Passages([(1, text)]).find("so " + " ".join(flat) + " end")) == allowed


def test_operator(spark):
    r = random.Random(1)
    items = [(k, item(r)) for k in range(5)] + [(8, None), (9, ""), (10, "too short"), (0, item(r))]
    docs = [(1, items[2][1]), (1, items[2][1]), (2, None), (3, ""), (4, "word " * 200_000 + items[3][1]), (5, "nothing at all"), (6, items[0][1] + " " + items[1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as eval_id", "'de' as lang")
    i = spark.createDataFrame(items, "eval_id bigint, text string").selectExpr("*", "2 as doc_id")
    found = sorted((x["doc_id"], x["eval_id"]) for x in leaked_passages(d, i).collect())
    assert found == [(1, 2), (1, 2), (4, 3), (6, 0), (6, 1)]
    assert leaked_passages(d.limit(0), i).count() == 0 and leaked_passages(d, i.limit(0)).count() == 0
    from tallyloom.llm import leakage

    kept, leakage.BLOCK_CHARS = leakage.BLOCK_CHARS, 300
    try:
        assert sorted((x["doc_id"], x["eval_id"]) for x in leaked_passages(d, i).collect()) == found
    finally:
        leakage.BLOCK_CHARS = kept


def test_many_copies_in_one_text():
    import time

    text = item(random.Random(9), 60)
    began = time.perf_counter()
    found = Passages([(1, text)]).find((text + " and again ") * 3000)
    assert found[0][:2] == (1, 0) and found[0][3:] == (60, 0) and time.perf_counter() - began < 20


def slipped(word):
    return word[:2] + "j" + word[3:]


@pytest.mark.parametrize(("length", "edits", "slips"), [(12, [5], [3, 8]), (16, [5, 10], [2, 7, 13]), (12, [], range(12)), (24, [6, 12, 18], range(24))])
def test_slips_beside_edits(length, edits, slips):
    r = random.Random(length)
    for _ in range(30):
        text = item(r)
        words = text.split()[3 : 3 + length]
        words = ["zzzz" if i in edits else slipped(w) if i in slips else w for i, w in enumerate(words)]
        found = Passages([(5, text)]).find("opening words come here first " + " ".join(words) + " and closing ones")
        assert [(f[0], f[3], f[4]) for f in found] == [(5, length, len(edits))]
        # One edit more than one in eight, at a place where nothing shorter is long enough.
        words[length // 2 + 1] = words[length // 2 - 2] = "yyyy"
        assert length > 16 or not Passages([(5, text)]).find(" ".join(words))


def test_words_longer_than_any_of_the_items():
    text = item(random.Random(2))
    assert Passages([(1, text)]).find("x" * 200_000 + " " + text)[0][0] == 1


def brute(item_words, doc_words, least=12, per_edit=8):
    """Whether some part of the item of least words or more, of which the first and the last are in the document, is within one edit in per_edit of some part of it: by the edit
    distance of all pairs of parts."""
    same = lambda a, b: a == b or near(a, b)
    for a in range(len(item_words) - least + 1):
        for d in range(len(doc_words)):
            if not same(item_words[a], doc_words[d]):
                continue
            rest = doc_words[d + 1 :]
            row = list(range(len(rest) + 1))
            for i, w in enumerate(item_words[a + 1 :], 2):
                new = [row[0] + 1]
                for j, v in enumerate(rest, 1):
                    if same(w, v) and i >= least and row[j - 1] * per_edit <= i:
                        return True
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not same(w, v))))
                row = new
    return False


def test_against_edit_distance_with_slips_in_any_word():
    r = random.Random(11)
    agreed = 0
    for _ in range(120):
        text = item(r, 26)
        own = text.split()
        a, n = r.randrange(0, 8), r.randrange(9, 19)
        part = list(own[a : a + n])
        for _ in range(r.randrange(0, 4)):
            x = r.randrange(len(part))
            part[x : x + 1] = r.choice([["zzzz"], [], [part[x], "yyyy"]])
        part = [slipped(w) if len(w) > 3 and r.random() < 0.4 else w for w in part]
        doc = ["opening"] * 2 + part + ["closing"] * 2
        keys = Words()(" ".join(doc))[0]
        want = brute(Words()(text)[0], keys)
        assert bool(Passages([(1, text)]).find(" ".join(doc))) == want
        agreed += want
    assert 20 < agreed < 110


def test_boilerplate_of_many_items_is_cheap():
    import time

    r = random.Random(6)
    item = lambda r, n: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n))
    common = item(r, 6)
    items = [(k, item(r, 12) + " " + common + " " + item(r, 12)) for k in range(20_000)]
    passages = Passages(items)
    doc = f"{item(r, 30)} {common} {item(r, 30)} {items[77][1]} {item(r, 10)} {common}"
    passages.find(doc)
    began = time.perf_counter()
    found = passages.find_numbered(doc)
    assert [(f[0], f[5]) for f in found] == [(77, 0)] and time.perf_counter() - began < 0.05


def test_every_passage_of_an_item_is_given():
    text = item(random.Random(3), 30)
    words = text.split()
    doc = f"{text} in between {' '.join(words[4:18])} once more {text}"
    found = Passages([(1, text)]).find_numbered(doc)
    assert [(f[3], f[5]) for f in found] == [(30, 0), (30, 1), (14, 2)]
    assert [doc[f[1] : f[2]].split() for f in found] == [words, words, words[4:18]]


def test_chinese_items():
    text = "长江大桥今天上午重新开放交通车辆可以通行"
    assert [f[3] for f in Passages([(1, text)]).find("报道：“" + text[2:16] + "”，记者说。")] == [14]
    assert Passages([(1, text)]).find("报道：“" + text[2:12] + "”，记者说。") == []
