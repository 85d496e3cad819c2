"""History that a template rewrites only in long conversations is reported."""

from tessera.llm import chat

TURNS = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(300)]


def line(turn):
    return f"[{turn[0]}:{turn[1]}]"


def test_template_that_keeps_the_last_hundred_turns():
    found = [s["rewrites_from"] for s in chat.spans(iter(TURNS), lambda ts: "".join(map(line, ts[-100:])))]
    assert found[:100] == [None] * 100 and None not in found[100:]


def test_template_that_shortens_the_first_turn():
    def render(ts):
        return "".join(map(line, ts)) if len(ts) < 100 else "[...]" + "".join(map(line, ts[1:]))

    found = [s["rewrites_from"] for s in chat.spans(iter(TURNS), render)]
    assert [i for i, x in enumerate(found) if x is not None] == [99] and found[99] == 1


def test_turn_local_spans_equal_those_of_whole_prefixes():
    whole = list(chat.spans(iter(TURNS), lambda ts: chat.marked_turns(ts)))
    assert list(chat.spans(iter(TURNS))) == whole
    assert "".join(s["piece"] for s in whole) == chat.marked_turns(TURNS)
