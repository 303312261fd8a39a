import base64
import quopri
import random

import numpy as np
import pytest

from foldstone.llm import abuse
from foldstone.llm.mailtext import GRAM, Letters, grams_of, readable

BAD = ["You are a worthless {} and everybody hates you.", "Shut your filthy mouth, {}.", "I will break your legs, {}."]
NAMES = ["idiot", "moron", "cretin", "imbecile", "jackass"]
GOOD = ["The {} moved the {} over the weekend.", "Please note that the {} has a new {}.", "We counted the {} behind the {} twice.", "Did the {} mention the {} at noon?"]
THINGS = ["vendor", "invoice", "warehouse", "route table", "price list", "cooling unit", "second reader", "replay log", "floor plan", "night shift"]


def message(rnd, bad):
    lines = [rnd.choice(GOOD).format(rnd.choice(THINGS), rnd.choice(THINGS)) for _ in range(rnd.randint(4, 10))]
    if bad:
        lines.insert(rnd.randint(0, len(lines)), rnd.choice(BAD).format(rnd.choice(NAMES)))
    else:
        lines.insert(0, "That old idiot light in the car is broken again.") if rnd.random() < 0.2 else None
    return "Subject: hello\nFrom: a.b@c.example\n\n" + "\n\n".join(lines) + "\n"


def corpus(seed, n):
    rnd = random.Random(seed)
    truth = [rnd.random() < 0.2 for _ in range(n)]
    return [message(rnd, b) for b in truth], truth


def tables(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, abusive int, reviewer string")


def test_held_out_accuracy(spark):
    texts, truth = corpus(1, 1200)
    rnd = random.Random(2)
    labels = [(i, int(truth[i] ^ (rnd.random() < 0.05)), "r") for i in range(600)]
    docs, reviewed = tables(spark, texts, labels)
    found = {r["doc_id"] for r in abuse.abusive(abuse.scores(docs, reviewed)).collect() if r["doc_id"] >= 600}
    want = {i for i in range(600, 1200) if truth[i]}
    assert len(found & want) / len(found) > 0.95 and len(found & want) / len(want) > 0.95


def test_hidden_spellings(spark):
    texts, truth = corpus(3, 600)
    labels = [(i, int(b), "r") for i, b in enumerate(truth)]
    line = "You are a worthless idiot and everybody hates you.\n"
    odd = [
        line.upper(),
        "Y0u are a w0rthle$$ id1ot and everyb0dy hates you.",
        "You are a worthless iiidddiot and everybody hatesss you!!!",
        "You are a w o r t h l e s s idiot and every​body ha­tes you.",
        "> > You are a worthless\n> > idiot and everybody\n> > hates you.\n",
        "Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(("x\n\n" + line).encode()).decode(),
        "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring((line + "=é").encode()).decode(),
        "<p>You are a worth<b>less</b> idiot &amp; everybody hates&nbsp;you.</p>",
        "Subject: =?utf-8?b?" + base64.b64encode(line.encode()).decode() + "?=\n\nhello\n",
    ]
    docs, reviewed = tables(spark, texts + odd, labels)
    got = {r["doc_id"]: r for r in abuse.scores(docs, reviewed).collect()}
    for i in range(len(odd)):
        r = got[len(texts) + i]
        assert r["abusive"], odd[i]
        assert r["passage"] and r["evidence"]
        assert truth[r["evidence_doc_id"]] and r["evidence_similarity"] >= abuse.FLOOR


def test_edge_cases(spark):
    docs, none = tables(spark, ["hello there, how are you today?", None, "", "x" * 300_000, "😀 \u0000"], [])
    assert [r["score"] for r in abuse.scores(docs, none).collect()] == [0.0] * 5
    _, odd = tables(spark, [], [(0, None, "r"), (None, 1, "r"), (99, 1, "r"), (1, 1, "r"), (1, 0, "q")])
    assert {r["score"] for r in abuse.scores(docs, odd).collect()} == {0.0}
    assert abuse.scores(docs.limit(0), odd).count() == 0


def test_rates_and_clashing_columns(spark):
    texts, truth = corpus(4, 300)
    docs, reviewed = tables(spark, texts, [(i, int(b), "r") for i, b in enumerate(truth)])
    scored = abuse.scores(docs.selectExpr("*", "1 as score", "2 as label", "3 as passages", "4 as abusive"), reviewed.selectExpr("*", "'x' as text", "1 as label"))
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, abuse.scores(docs, reviewed).collect()))
    got = {r["source"]: r for r in abuse.rates(scored).collect()}
    found = {r["doc_id"] for r in abuse.abusive(scored).collect()}
    assert got[None]["documents"] == 150 and got[None]["abusive"] == sum(i % 2 == 0 for i in found)
    assert got["s"]["rate"] == pytest.approx(sum(i % 2 for i in found) / 150)


def test_the_index_finds_exactly_the_similar_examples():
    texts, _ = corpus(5, 200)
    passages = sorted({p for t in texts for p in Letters([readable(t)]).passages()})
    examples, queries = passages[::2], passages[1::2]
    codes, which = grams_of(passages)
    idf = np.log((1 + len(passages)) / (1 + np.bincount(np.unique(which * abuse.TERMS + codes) % abuse.TERMS, minlength=abuse.TERMS))).astype(np.float32)
    index = abuse.Examples.build(examples, np.ones(len(examples)), np.ones(len(examples)), np.arange(len(examples)), idf, 0.2)

    def dense(ps):
        c, p, w = abuse.weigh(*grams_of(ps), len(ps), idf)
        out = [{} for _ in ps]
        for a, b, x in zip(p.tolist(), c.tolist(), w.tolist()):
            out[a][b] = x
        return out

    for floor in (0.2, 0.5, 0.8):
        q, e, s = index.similar(*grams_of(queries), len(queries), floor)
        got = {(a, b): c for a, b, c in zip(q.tolist(), e.tolist(), s.tolist())}
        want = {}
        for i, a in enumerate(dense(queries)):
            for j, b in enumerate(dense(sorted(examples))):
                cosine = sum(x * b.get(t, 0) for t, x in a.items())
                if cosine >= floor + 1e-9:
                    want[i, j] = cosine
        assert {k for k in want} <= set(got) and all(got[k] == pytest.approx(v) for k, v in want.items())
        assert all(v >= floor for v in got.values())


def test_grams_stay_within_passages():
    letters = Letters(["abcdefghijkl mnop. qrstuvwxyzab!\n\nshort", None or "", "aaaabbbbccccddddeeeeffffgggghhhhiiiijjjj"])
    passages = letters.passages()
    assert passages == [b"abcdefghijklmnop", b"qrstuvwxyzab", b"short", b"abcdefghij"]
    assert letters.text.tolist() == [0, 0, 0, 2] and letters.example.tolist() == [True, True, False, True]
    codes, which = letters.grams()
    again, where = grams_of(passages)
    assert codes.tolist() == again.tolist() and which.tolist() == where.tolist()
    assert len(codes) == sum(len(p) - GRAM + 1 for p in passages)


def test_short_sentences_are_passages():
    texts = ["Fuck you. See the report.", "You idiot!", "Read it now, please. You idiot", "Idiot!", "A word, my friend. Die!\n\nOk", "Die! You are late", "No.", "Go!\n\nLast line here"]
    letters = Letters(texts)
    own = [[p for p, t in zip(letters.passages(), letters.text) if t == i] for i in range(len(texts))]
    assert own == [[b"fuckyou", b"sethereport"], [b"youidiot"], [b"readitnowpleaseyouidiot"], [b"idiot"], [b"awordmyfrienddieok"], [b"dieyouarelate"], [], [b"golastlinehere"]]


def test_letters_beyond_the_basic_plane():
    assert Letters(["".join(chr(0x1D400 + ord(c) - 65) for c in "COMPLETEFOOL")]).passages() == [b"completefol"]
    assert Letters(["".join(chr(0x1F150 + ord(c) - 65) for c in "COMPLETEFOOL") + "\U0001f600"]).passages() == [b"completefol"]


def test_broken_base64_is_read_as_far_as_it_goes():
    body = base64.b64encode(b"You are a complete and utter fool, sir.").decode()
    head = "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n"
    for cut in range(1, 4):
        assert "complete and utter fool" in readable(head + body[:-cut] + "\n")


SHORT = ["You idiot!", "fuck you", "Fuck off.\n\nRegards", "an: you filthy worthless idiot, go away\n", "Hello,\nto: fuck you\n\nbye", "fuck.you@example.com", "".join(chr(0x1D41A + ord(c) - 97) for c in "fuckyou")]


def test_short_texts_and_lines_of_addresses_are_scored(spark):
    rnd = random.Random(6)
    bad = ["You idiot!", "Fuck you.", "Fuck off.", "Go away you filthy worthless idiot.", "You filthy worthless idiot."]
    texts, labels = [], []
    for i in range(300):
        text = message(rnd, False)
        texts.append(text.replace("\n\n", f"\n\n{rnd.choice(bad)}\n\n", 1) if i % 4 == 0 else text)
        labels.append((i, int(i % 4 == 0), "r"))
    docs, reviewed = tables(spark, texts + SHORT, labels)
    got = {r["doc_id"]: r for r in abuse.scores(docs, reviewed).collect()}
    assert [t for i, t in enumerate(SHORT) if not got[300 + i]["abusive"]] == []


def test_every_letter_is_in_a_passage():
    texts = ["To: ab example,\n  de f\nSubject: x\n\nHi\n\nGo in. No\n\n9\n\nIt", "", "ab", "abc\ndefg"]
    letters = Letters(texts)
    want = [sum(c.isascii() and c.isalpha() for c in t) for t in texts]
    got = [sum(e - s for s, e, t in zip(letters.start, letters.end, letters.text) if t == i) for i in range(len(texts))]
    assert got == [want[0], 0, 0, 7]
    assert not letters.example[letters.text == 0][0]


def test_isotonic_scores_and_threshold():
    votes, label = np.array([0, 0, 0.2, 0.4, 0.6, 0.7, 0.9, 0.95]), np.array([0, 0, 0, 1, 0, 1, 1, 1.0])
    x, y = abuse.isotonic(votes, label)
    assert (np.diff(y) >= 0).all() and np.interp([0.1, 0.5, 0.92], x, y).tolist() == [0, 0.5, 1]
    assert abuse.best_threshold(votes, label) == pytest.approx(0.3)
    assert abuse.best_threshold(np.zeros(5), np.ones(5)) == abuse.USUAL == abuse.best_threshold(np.zeros(0), np.zeros(0))
