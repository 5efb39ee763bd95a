import hashlib
import itertools
import json
import random
import re

import pytest

from chronoweft.llm import secret_scan as S
from tests.llm.helpers import ODD_TEXTS, docs_of, with_clashes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
RANKS = S.listed_words()
TEXTS = [
    *ODD_TEXTS,
    "é password = hunter2hunter and TOKEN: 'abc.def-123' x",
    "secret=token: abcdefgh", "token=token=abcdef", "passwd : abc", "api_key=AKIA" + "A1" * 10 + " AKIAAKIA12 AKIA" + "Z" * 15,
    "id " + "0123456789abcdef" * 2 + " " + "ab" * 11 + "g" + "cd" * 12, "ab" * 11, "ba" * 12, "pwd is Tr0ub4dor&3xQz!", "auth: qwertyuiop",
]


def by_hand(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found.sort()
    said = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in found)
    return [sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(said.encode()).hexdigest(), said.split(",") if said else []


def test_base_spans_by_hand(spark):
    got = S.scan_secrets(with_clashes(docs_of(spark, TEXTS))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        counts, sha, spans = by_hand(TEXTS[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts, TEXTS[r.doc_id]
        assert r.base_sha256 == sha
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == spans
    weak, strong = (next(r for r in got if (TEXTS[r.doc_id] or "").startswith(x)) for x in ("auth", "pwd"))
    assert weak.n_guess == 0 and strong.n_guess == 1


def test_empty_table(spark):
    assert S.scan_secrets(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("value", ["password1", "qwerty99", "aaa2001", "zzzabcz", "P4ssword", "xk2", "abab12"])
def test_guess_cost_is_the_least_of_all_segmentations(value):
    parts = {}
    for i, j, c in S.segments(value, RANKS):
        parts[i, j] = min(c, parts.get((i, j), 99))
    best = 99
    n = len(value)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        total = (len(edges) - 2) * S.SEGMENT
        for a, b in zip(edges, edges[1:], strict=False):
            total += min(parts.get((a, b), 99), sum(map(S.char_cost, value[a:b])))
        best = min(best, total)
    assert abs(S.guess_cost(value, RANKS) - best) < 1e-9


def test_habits_are_cheaper_than_chance():
    for weak in ("password123", "qwertyuiop", "abcabcabcabc", "summer2019!", "1999-12-31x"):
        assert S.guess_cost(weak, RANKS) < 8 < S.guess_cost("v9Q#xT2m$Lw7", RANKS) - 2


def test_mask(spark):
    docs = with_clashes(docs_of(spark, TEXTS))
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in S.mask_secrets(docs).collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert r.asDict().keys() == before[k].asDict().keys()
        if by_hand(before[k].text)[2]:
            assert "[secret]" in r.text and r.n_chars == len(r.text) and not by_hand(r.text)[2]
        elif "pwd" not in (before[k].text or ""):
            assert r == before[k]


STRONG = "Zq8#vL2!pRw9x@K"
KEYS = ("password", "passwd", "passphrase", "passcode", "pass", "pwd", "secret", "token", "credentials", "credential", "auth", *(f"{a}{b}key" for a in ("api", "access", "private", "secret") for b in ("", "_", "-")))


def values_by_hand(text):
    """(start, end) of the value of each key, read character by character; keys within a value are part of it."""
    low, out, done = text.lower(), [], 0
    for i in range(len(text)):
        for key in KEYS:
            at = i + len(key)
            if not low.startswith(key, i):
                continue
            at += text[at : at + 1] in ("'", '"')
            while text[at : at + 1] in (" ", "\t"):
                at += 1
            if text[at : at + 1] == ":":
                at += 1
            elif text[at : at + 1] == "=":
                at += 2 if text[at + 1 : at + 2] == ">" else 1
            elif text[at - 1] in " \t" and text[at : at + 2] == "is" and text[at + 2 : at + 3] in (" ", "\t"):
                at += 2
            else:
                continue
            while text[at : at + 1] in (" ", "\t"):
                at += 1
            at += text[at : at + 1] in ("'", '"')
            end = at
            while end < len(text) and "!" <= text[end] <= "~" and text[end] not in "\"'<>,;()[]{}":
                end += 1
            if at >= done and end > at:
                done = end
                out.append((at, at + len(text[at:end].rstrip(".:!?"))))
            break
    return [x for x in out if x[0] < x[1]]


@pytest.mark.parametrize("text, n", [
    (f'{{"auth":"none","pwd":"{STRONG}"}}', 1), (f"auth=none;pwd={STRONG}", 1), (f"pwd={STRONG};private_key={STRONG},auth:{STRONG}", 3),
    (f'{{"pwd":"","auth":"{STRONG}"}}', 1), (f"auth:token='{STRONG}'", 1), (f"auth:token: {STRONG}", 1),
])
def test_every_credential_of_a_run_is_tried(text, n):
    found = S.guess_spans(text.encode(), RANKS, 10.0, 8)
    assert [text[a:b] for a, _, b, _ in found] == [STRONG] * n
    assert STRONG.encode() not in S.masked(text.encode(), RANKS, 10.0, 8)


@pytest.mark.parametrize("habit", ["undefined", "disabled", "elephant", "configuration", "notAvailable", "changeme2024", "example_value", "required"])
def test_words_are_no_secrets(habit):
    text = f'{{"pwd":"{habit}","auth":"{STRONG}","passphrase":"{habit}"}}'.encode()
    assert S.guess_cost(habit, RANKS) < 10
    assert [text[a:b].decode() for a, _, b, _ in S.guess_spans(text, RANKS, 10.0, 8)] == [STRONG]


def test_words_of_the_corpus(spark, tmp_path):
    """Words are ranked by their number over all rows, copies and letters of either case included, and the
    values under test don't count."""
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {f"{w}</w>": i for i, w in enumerate([*(f"{a}{b}zzz" for a in "abcdefghij" for b in "abcdefghij"), "zorblatt", "fnordicle", "qwvxkzjbnm", "ab", "x1y"])} | {"part": 999}}}))
    paths = (str(tmp_path / "v.json"),)
    before = S.listed_words(paths)
    assert before["zorblatt"] == 101 and not {"ab", "x1y", "part"} & before.keys()
    texts = [*ODD_TEXTS, "Zorblatt fnordicle zorblatt", "fnordicle zorblatt ab abc9 x_y", "pwd: qwvxkzjbnm and pwd: qwvxkzjbnm zorblatt", "mülz zork\nzork," + "y" * 17]
    words = S.learn_words(with_clashes(docs_of(spark, texts)), paths)
    assert words.keys() == before.keys() and (words["zorblatt"], words["fnordicle"]) == (1, 2)
    assert {w for w in words if words[w] != before[w]} <= {"zorblatt", "fnordicle", "and"} and words["qwvxkzjbnm"] == 103
    assert S.learn_words(docs_of(spark, []), paths) == before
    (row,) = S.scan_secrets(docs_of(spark, ["pwd=zorblattFnordicle auth=xorblqttFmordizle"]), dictionary=words).collect()
    assert row.spans == "guess:27:44"


def test_values_by_brute_force():
    rng = random.Random(3)
    parts = [*KEYS, "none", STRONG, "x1", "is", *"\"\"'':::===>;;,,{}()[]<&.!? \t"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        if rng.random() < 0.5:
            text = rng.choice([",", ";", "&"]).join(f"{q}{rng.choice(KEYS)}{q}{rng.choice(':=')}{q}{rng.choice(parts)}{q}" for q in rng.choices(["", '"', "'"], k=4))
        assert [(a, b) for a, _, b, _ in S.guess_spans(text.encode(), RANKS, 0.0, 1)] == values_by_hand(text), text
