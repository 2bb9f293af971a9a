"""Quotation linking on small conversations, and the plain case against a brute-force version."""

import itertools
import random
import re

from tallymark.llm.quote_links import ADDED, link


def rows(spark, data, schema="conv_id long, turn long, role string, text string"):
    return {(r["conv_id"], r["turn"]): r for r in link(spark.createDataFrame(data, schema)).collect()}


def test_quotes_lead_to_their_messages(spark):
    got = rows(spark, [
        (1, 0, "a", "Where do we meet tomorrow?\n\nI could bring the old maps with me."),
        (1, 1, "b", "> Where do we meet tomorrow?\nAt the station."),
        (1, 2, "c", "> I could bring the old maps with me.\nYes please."),
        (1, 3, "a", "b wrote:\n> > Where do we meet tomorrow?\n> At the station.\nWhich one?"),
        (1, 4, "d", "> never said by anybody here\nHm."),
        (1, 5, "e", ">WHERE   do we meet, tomorrow\n\n\n\nagain"),
    ])
    assert {k[1]: r["reply_to"] for k, r in got.items()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 3, 5: 0}
    assert {k[1]: r["quoted"] for k, r in got.items()} == {0: False, 1: True, 2: True, 3: True, 4: False, 5: True}
    assert {k[1]: r["depth"] for k, r in got.items()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 1}
    assert all(r["root"] == 0 for r in got.values())
    assert got[1, 3]["own_text"] == "Which one?" and got[1, 1]["own_text"] == "At the station."


def test_the_latest_equal_message_and_ranges(spark):
    data = [(1, i, "a", "the same words in every message") for i in range(0, 900, 3)] + [(1, 1000, "b", "> the same words in every message\nno")]
    got = rows(spark, data)
    assert got[1, 1000]["reply_to"] == 897 and got[1, 300]["reply_to"] == 297 and got[1, 768]["reply_to"] == 765
    assert got[1, 897]["depth"] == 299 and got[1, 1000]["depth"] == 300 and got[1, 1000]["root"] == 0


def test_odd_rows(spark):
    got = link(spark.createDataFrame([(None, 1, "a", "x"), (1, None, "a", "y"), (2, 0, "a", None), (2, 0, "a", "twice"), (2, 1, "b", "> twice\n"), (3, 5, "a", "> quote of nothing")], "conv_id long, turn long, role string, text string")).collect()
    by = sorted((str(r["conv_id"]), str(r["turn"]), str(r["text"]), r["reply_to"], r["own_text"]) for r in got)
    assert by == [("1", "None", "y", None, "y"), ("2", "0", "None", None, ""), ("2", "0", "twice", None, "twice"), ("2", "1", "> twice\n", 0, ""), ("3", "5", "> quote of nothing", None, ""), ("None", "1", "x", None, "x")]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert link(empty).count() == 0
    extra = spark.createDataFrame([(1, 0, "a", "hello", 7, "kept?")], "conv_id long, turn long, role string, text string, depth int, `a b` string")
    row = link(extra).first()
    assert row["depth"] == 0 and row["depth_given"] == 7 and row["a b"] == "kept?"
    names = ["_turn", "_conv", "_own", "quotes", "quotes_given", "c0", "root"]
    odd = spark.createDataFrame([(1, 0, "hello", *range(7))], "conv_id long, turn long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = link(odd)
    assert got.columns == ["conv_id", "turn", "text", "_turn", "_conv", "_own", "quotes_given_", "quotes_given", "c0", "root_given", *ADDED]
    assert list(got.first())[3:10] == list(range(7)) and got.first()["reply_to"] is None


def brute(rows):
    """reply_to and quotes of each turn, by reading all earlier messages of its conversation."""
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    out, known = {}, {}
    for conv, turn, text in sorted(rows):
        lines = text.split("\n")
        depth = [len(re.match(r"(?:[ \t]*>)*", x).group().replace(" ", "").replace("\t", "")) for x in lines]
        own = [x for i, x in enumerate(lines) if not depth[i] and not (re.search(r"wrote:\s*$", x) and i + 1 < len(lines) and depth[i + 1])]
        found = set()
        for d, run in itertools.groupby(zip(depth, lines, strict=True), key=lambda p: p[0]):
            body = [re.sub(r"^(?:[ \t]*>)+ ?", "", x) for _, x in run]
            for w, unit in [(1, "\n".join(body)), *((0, x) for x in body)] if d else []:
                n = norm(unit)
                at = max((t for t, units in known.get(conv, []) if n and n in units), default=None)
                if at is not None:
                    found.add((-d, w, len(n), at))
        past = [t for t, _ in known.get(conv, [])]
        out[conv, turn] = (max(found)[3] if found else max(past, default=None), sorted({(-d, t) for d, _, _, t in found}))
        whole = "\n".join(own)
        known.setdefault(conv, []).append((turn, {norm(u) for u in [whole, *re.split(r"\n[ \t\r]*\n\s*", whole), *own]} - {""}))
    return out


def test_generated_quotations_against_brute_force(spark):
    rng = random.Random(9)
    words = "map train bread river stone cloud paper ok no yes".split()
    data = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randrange(2, 25)):
            parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 4))]
            for _ in range(rng.randrange(0, 3) if texts else 0):
                if rng.random() < 0.5:
                    parts.append("On Monday, a person with a rather long name and address wrote:")
                quoted = rng.choice(texts).split("\n")
                cut = rng.randrange(len(quoted))
                parts += [("> " if rng.random() < 0.7 else ">") + x for x in quoted[cut : cut + rng.randrange(1, 6)]]
                parts += [""] * rng.randrange(2)
            texts.append("\n".join(parts))
            data.append((conv, turn * 3, texts[-1]))
    got = rows(spark, data, "conv_id long, turn long, text string")
    want = brute(data)
    assert {k: (r["reply_to"], [tuple(q) for q in r["quotes"]]) for k, r in got.items()} == want
    assert sum(any(d > 1 for d, _ in q) for _, q in want.values()) > 10  # deeper levels are linked too


def test_long_conversations_are_cut_into_ranges_of_ranges(spark, monkeypatch):
    """Quotations of messages in the same range, the same wider range, and before it."""
    from tallymark.llm import quote_links

    monkeypatch.setattr(quote_links, "RANGE_TURNS", 4)
    monkeypatch.setattr(quote_links, "WIDE_RANGES", 3)
    rng = random.Random(10)
    data = []
    for conv in range(3):
        texts = [f"said {conv} {t} word" for t in range(60)]
        for t in range(1, 60):
            if rng.random() < 0.6:
                texts[t] += f"\n> {texts[rng.randrange(t)].splitlines()[0]}"
        data += [(conv, 2 * t, x) for t, x in enumerate(texts)]
    got = rows(spark, data, "conv_id long, turn long, text string")
    assert {k: (r["reply_to"], [tuple(q) for q in r["quotes"]]) for k, r in got.items()} == brute(data)


def test_a_message_of_many_lines(spark):
    long = "\n".join(f"{'>' * (1 + i % 3)} line {i}" for i in range(60_000))
    got = rows(spark, [(1, 0, "line 5"), (1, 1, long), (1, 2, "x" * 1_000_000)], "conv_id long, turn long, text string")
    assert got[1, 1]["reply_to"] == 0 and [tuple(q) for q in got[1, 1]["quotes"]] == [(3, 0)] and got[1, 1]["own_text"] == ""


def test_whole_table_in_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = link(table).collect()
    plain = sorted((r["conv_id"], r["turn"]) for r in table.collect())
    assert [(r["conv_id"], r["turn"]) for r in got] == plain  # nothing is quoted here: a chain in order of turns
    before = {}
    for c, t in plain:
        before[c, t] = max((x for y, x in plain if y == c and x < t), default=None)
    assert all(r["reply_to"] == before[r["conv_id"], r["turn"]] for r in got)
