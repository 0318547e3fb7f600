import random
import re

import pytest

from larkspool.llm import pii_crf as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expected(text):
    """Base spans by the plain patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    dice = random.Random(4)
    pieces = ["a.b@c.de", "@", ".", "@x", "1.2.3.4", "255.0.00.1", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (942) 555-3625",
              "+", "é", " ", "-", "(", ")", "٣", "0", "99", "x", "\n", "5.6", "%", "_", "00000000000000"]
    for _ in range(4000):
        text = "".join(dice.choice(pieces) for _ in range(dice.randrange(1, 14)))
        assert P.base_spans(text) == expected(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "(" * 300_000, "1." * 150_000, "a@b" * 100_000, "+1 " * 100_000, "1 [at" * 60_000):
        P.nodes_of(text + " 1.2.3.4")


def card(dice):
    digits = "".join(dice.choice("0123456789") for _ in range(15))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def corpus(dice, n):
    """Texts with personal data, numbers that are none, and a second writing of one entity; what must be added to the base."""
    rows = []
    for i in range(n):
        entity, kind = dice.choice([(card(dice), "card"), (f"+1 ({dice.randrange(100, 999)}) 555-{dice.randrange(1000, 9999)}", "phone")])
        other = entity[:4] + str((int(entity[4]) + 1) % 10) + entity[5:] if kind == "card" else entity.replace("+1 (", "").replace(") ", "-")
        decoy = re.sub("[0-9]", lambda _: dice.choice("0123456789"), card(dice))
        decoy = decoy if not luhn(decoy) else str((int(decoy[0]) + 1) % 10) + decoy[1:]
        added = []
        text = f"Text {i} says {entity} and order {decoy} of "
        if i % 2:
            added = [(kind, len(text), len(text) + len(other))]
            text += other + " "
        rows.append((i, text + "word " * dice.randrange(200) + "end.", added))
    return rows


def test_similar_writings_are_found_and_other_numbers_left_alone(spark, docs_of):
    rows = corpus(random.Random(8), 400)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in P.find_personal_data(docs_of([r[:2] for r in rows])).collect()}
    hits = wrong = wanted = 0
    for i, text, added in rows:
        got = spans[i]
        assert [s[:3] for s in got if s[3]] == expected(text)
        more = {s[:3] for s in got if not s[3]}
        wanted += len(added)
        hits += len(more & set(added))
        wrong += len(more - set(added))
    assert hits >= 0.9 * wanted and wrong <= 0.02 * len(rows), (hits, wanted, wrong)


def test_labels_reach_over_several_links():
    field = P.train([([(card(random.Random(k)), "card"), ("12345678", None)], k) for k in range(60)])
    a = card(random.Random(99))
    copies = [a, *(a[:k] + str((int(a[k]) + 3) % 10) + a[k + 1 :] for k in (2, 5, 9))]
    labels = P.label_nodes(field, [[(a, "card"), ("77777777", None), *((c, None) for c in copies[1:])], [("9999888877776666", None)]])
    assert labels[0][0] == "card" and labels[0][1] is None and labels[0][2:] == ["card"] * 3 and labels[1] == [None]


def test_links_grow_with_the_nodes():
    same = ["4111111111111111"] * 3000
    assert len(P.links_of(same, [False] * 3000)) < 2 * 3000


@pytest.mark.parametrize("rows", [[(1, None), (2, ""), (None, "x"), (3, "mail a@b.cd"), (3, "mail a@b.cd"), (4, "n" * 4_000 + " é" * 100_000 + " 1.2.3.4")]])
def test_nulls_repeats_and_long_texts(spark, docs_of, rows):
    df = docs_of(rows).withColumnsRenamed({"source": "nodes", "lang": "spans"})
    got = sorted(((r["doc_id"], [tuple(s)[:3] for s in r["spans"] if s["base"]]) for r in P.find_personal_data(df).collect()), key=repr)
    assert got == sorted(((i, expected(t)) for i, t in rows), key=repr)


def test_empty_table_and_no_base_span(spark, docs_of):
    assert P.find_personal_data(docs_of([(1, "a")]).limit(0)).collect() == []
    assert [r["spans"] for r in P.find_personal_data(docs_of([(1, "call 123 456 7890")])).collect()] == [[]]


def test_mask():
    text = "to a@b.cd or 1.2.3.4!"
    assert P.masked(text, P.base_spans(text)) == "to <email> or <ip>!"
