from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetables.llm import chat

PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, content string, n long"


def back(formatted):
    return {r[0]: r for r in formatted.select(
        "conv_id", "formatted", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "attachments", "expanded_tokens").collect()}


pieces = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", "\n", "assistant", "%0A", "é😀", "<\\|", "<|image|>", "x" * 50, "$1"]), max_size=9).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.sampled_from(["user", "assistant", "ro\nle", "%0A", "<|im_end|>"])), st.one_of(st.none(), pieces)), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    rows = [(conv, i, role, text) for i, (conv, role, text) in enumerate(turns)]
    got = back(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv].turns] == mine
        assert got[conv].loss == "".join(t for role, t in mine if role == "assistant")
        assert got[conv].formatted.count("<|") == 2 * len(mine)


def test_parts_become_placeholders_in_order(spark):
    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return (kind, text, ref, width, height, seconds, pages)

    rows = [
        (1, 1, "assistant", [part("text", "so"), part("odd", "<|audio|>"), part(None, "!")], "clash", 5),
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=2.01),
                        part("document", ref="c.pdf", pages=3), part("image")], "clash", 5),
        (2, 0, "user", None, None, None), (2, 1, "user", [], None, None), (None, 0, None, [part("text")], None, None)]
    got = back(chat.format_chat(spark.createDataFrame(rows, PARTS), parts_col="parts"))
    assert [t.content for t in got[1].turns] == ["see <|image|><|audio|><|document|><|image|>", "so<|audio|>!"]
    assert [tuple(a) for a in got[1].attachments] == [
        (1, "image", "a.png", 4), (1, "audio", "b.wav", 51), (1, "document", "c.pdf", 1536), (1, "image", None, 1)]
    assert got[1].expanded_tokens == 1592
    assert [t.content for t in got[2].turns] == ["", ""] and got[2].loss == "" and got[None].n_turns == 1


def test_ties_repeats_and_empty_table(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [t.content for t in back(chat.format_chat(df))[1].turns] == ["first", "a", "a", "b"]
    assert chat.format_chat(df.limit(0)).count() == 0
