import itertools
import re
from collections import Counter

import regex

from terralign.llm import quotes


def messages():
    long = "filler line\n" * 5_000 + "the tail"
    return [
        (1, 0, "user", "How do I sort a list?\nI tried everything."),
        (1, 1, "assistant", "Use sorted.\nIt returns a new list."),
        (1, 2, "user", "On Monday a helper wrote:\n> How do I sort a list?\nStill the first question."),
        (1, 3, "assistant", "> > How do I sort a list?\n> Still the FIRST question\n\nLike this."),
        (2, 0, "user", "> It returns a new list.\nDoes it?"),
        (3, 0, "user", None),
        (3, 1, "assistant", ""),
        (3, 3, "user", "a gap before me"),
        (4, 0, "user", long),
        (4, 1, "assistant", "> the tail\nyes"),
        (4, 1, "assistant", "> the tail\nyes"),
        (None, 0, "user", "> lost\nhere"),
        (5, None, "user", "there"),
    ]


def test_quotes_link_messages(spark):
    frame = spark.createDataFrame([(*m, "clash") for m in messages()], "conv_id long, turn long, role string, text string, depth string")
    got = {(r.conv_id, r.turn): r for r in quotes.link(frame).collect()}
    reply = {k: (r.reply_conv, r.reply_turn) for k, r in got.items()}
    assert reply[1, 0] == (None, None) and reply[1, 1] == (1, 0)
    assert reply[1, 2] == (1, 0) and got[1, 2].text == "Still the first question."
    assert reply[1, 3] == (1, 2) and got[1, 3].text == "Like this."
    assert reply[2, 0] == (1, 1) and (got[2, 0].root_conv, got[2, 0].root_turn, got[2, 0].depth) == (1, 0, 2)
    assert got[1, 3].depth == 2 and (got[1, 3].n_quoted, got[1, 3].n_linked) == (2, 2)
    assert reply[3, 3] == (None, None) and reply[3, 1] == (3, 0) and got[3, 0].text == ""
    assert reply[4, 1] == (4, 0) and len(got) == len(set(messages()))
    assert got[None, 0].text == "here" and got[5, None].depth == 0


def test_messages_of_one_turn_stay_apart(spark):
    rows = [(1, 0, "user", "What holds the roof?"), (1, 0, "user", "Which beam is it?"), (1, 1, "assistant", "> Which beam is it?\nThe oak one."), (1, 2, "user", "> What holds the roof?\nTell me."), (1, 0, "user", None)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5
    part = {r.text: r.part for r in got if r.turn == 0}
    reply = {r.text: (r.reply_turn, r.reply_part, r.n_linked) for r in got if r.turn}
    assert reply == {"The oak one.": (0, part["Which beam is it?"], 1), "Tell me.": (0, part["What holds the roof?"], 1)}


def test_many_lines_in_a_message(spark):
    text = "".join(f"{'> ' * (i % 3)}line number {i}\n" for i in range(20_000))
    rows = [(1, 0, "user", "\n".join(f"line number {i}" for i in range(0, 20_000))), (2, 0, "user", text)]
    got = {r.conv_id: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2].reply_conv, got[2].n_linked) == (1, got[2].n_quoted)


def test_empty_table(spark):
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_whole_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {(r.conv_id, r.turn, r.role, r.text): (r.reply_conv, r.reply_turn, r.root_conv, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in quotes.link(frame).collect()}
    messages = {}
    for r in frame.collect():
        messages[r.conv_id, r.turn, r.role, r.text] = [(re.match(r"(?: {0,3}>)*", x)[0].count(">"), re.sub(r"^(?: {0,3}>)+", "", x).strip(" ")) for x in re.split(r"\r?\n", r.text or "")]
    assert len({m[:2] for m in messages}) == len(messages)

    def normal(text):
        return regex.sub(r"^[\s\p{P}]+|[\s\p{P}]+$", "", re.sub(r"\s+", " ", text.lower()))

    def said(lines):
        runs = [(k, [c for _, c in g]) for k, g in itertools.groupby(lines, key=lambda x: x[0])]
        every = [*lines, *((k, " ".join(c)) for k, c in runs if len(c) > 1)]
        return {(k, normal(c)) for k, c in every} - {(k, "") for k, _ in every}

    here, first = {}, {}
    for (conv, turn, *_), lines in messages.items():
        for level, text in said(lines):
            if level == 0:
                here[conv, text] = min(here.get((conv, text), turn), turn)
                first[text] = min(first.get(text, (conv, turn)), (conv, turn))
    reply, counts = {}, {}
    for (conv, turn, *_), lines in messages.items():
        votes, quoted = Counter(), [x for x in said(lines) if x[0]]
        for level, text in quoted:
            if here.get((conv, text), turn) < turn:
                votes[-level, (conv, here[conv, text])] += 1
            elif text in first and first[text] < (conv, turn):
                votes[-level, first[text]] += 1
        best = max(((level, n, source) for (level, source), n in votes.items()), default=None)
        reply[conv, turn] = best[2] if best else (conv, turn - 1) if any(m[:2] == (conv, turn - 1) for m in messages) else None
        counts[conv, turn] = (len(quoted), sum(votes.values()))
    assert len(got) == len(messages)
    for (conv, turn, *_), row in got.items():
        top, depth = (conv, turn), 0
        while reply[top]:
            top, depth = reply[top], depth + 1
        assert row == (*(reply[conv, turn] or (None, None)), *top, depth, *counts[conv, turn])
