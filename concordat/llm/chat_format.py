"""Chat formatting from an event log, in DataFrame functions alone.

A log has rows (conv_id, turn, msg, seq, kind, role, text). Events of one message are its rows with
the same conv_id, turn and msg, folded in the order of seq (then kind, role, text):

* ``message`` opens it with a role and a first text, ``edit`` replaces the text, ``regenerate``
  throws it away for a new first text;
* ``delta`` appends.

So the final text is that of the last event that is not a delta, and all deltas after it. Events may come in any order, and
one that is delivered again (all columns equal) counts once. Messages of a
conversation stand by turn (null first), then msg. A null text adds nothing; the role is the last one given
by an event, or empty.

Rendering marks a turn as ``<|turn|>role\\ntext<|end|>``. Inside roles and texts a backslash is
doubled and each control string gets a backslash after its first character, so no marker can
arise from a text; a new line in a role gets one before it. Dropping each backslash that stands before a character
gives the text back. The loss mask has the place of each assistant text, in code points and in bytes.

Defined results: an empty log, or an empty table of rows, gives no conversations. Rows that are repeated are messages each (they
differ in msg). A null conv_id or turn is a value like others. Columns other than those named are not read, whatever their names.

Deltas are folded under (conv_id, turn, msg), so a long conversation is spread over tasks up to
the last step, where its turns become the one value that is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return F.replace(out, F.lit("\n"), F.lit("\\\n")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, role, text): the final messages of the log."""
    ordered = F.array_sort(F.collect_set(F.struct("seq", "kind", "role", "text")))
    held = events.groupBy("conv_id", "turn", "msg").agg(ordered.alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].eqNullSafe("delta"), 0).otherwise(i)))
    parts = F.transform(F.slice("log", last + 1, F.size("log")), lambda e: F.coalesce(e["text"], F.lit("")))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return held.select("conv_id", "turn", "msg", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one text per conversation and the places of what is trained on."""
    body = escape(F.col("text"))
    head = F.concat(F.lit(TURN), escape(F.col("role"), role=True), F.lit("\n"))
    turns = messages.select("conv_id", "turn", "msg", "role", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("part", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn", "msg").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + F.length("head")
    octets = F.coalesce(F.sum(F.octet_length("part")).over(before), F.lit(0)) + F.octet_length("head")
    place = F.struct(
        chars.alias("start"), (chars + F.length("body")).alias("end"),
        octets.alias("byte_start"), F.octet_length("body").alias("bytes"),
    )
    turns = turns.withColumn("place", F.when(F.col("role") == "assistant", place))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "msg", "part", "place"))).alias("turns"))
    places = F.filter(F.transform("turns", lambda t: t["place"]), lambda p: p.isNotNull())
    return held.select("conv_id", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"), places.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text of each turn) and ``loss_text``, both read from the rendered text."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.length(p) - len(END)))
    name = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, name, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, F.length(role) + 2, F.length(p))).alias("text"))

    raw = F.col("formatted").cast("binary")
    cut = F.transform("loss", lambda s: unescape(F.substring(raw, (s["byte_start"] + 1).cast("int"), s["bytes"]).cast("string")))
    return formatted.withColumn("turns", F.transform(inner, turn)).withColumn("loss_text", F.array_join(cut, ""))


def conversation_events(rows: DataFrame, chunk: int = 256) -> DataFrame:
    """A log that ends in the messages of ``rows``, as a stream would give it, out of order.

    Each message is opened with a draft that a delta goes on with. An assistant's draft is then thrown away by a ``regenerate``, others'
    are replaced by an ``edit``, with the first ``chunk`` characters of the true text; a delta for every ``chunk`` more follows. Every
    third event is delivered twice. Events are dealt out by conversation, turn and number, so those of a message meet only in the fold.

    Rows with one conv_id and turn are different messages, numbered by role and text.
    """
    turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    numbered = rows.select("conv_id", "turn", "role", text.alias("text"), F.row_number().over(turn).alias("msg"))
    # Events 0 and 1 are the draft, 2 replaces it.
    last = F.floor(F.length("text") / chunk).cast("int") + 2
    seq = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i % 3 == 1, F.array(i, i)).otherwise(F.array(i)))))
    seen = numbered.withColumn("seq", seq)
    n = F.col("seq")
    replaced = F.when(F.col("role").eqNullSafe("assistant"), "regenerate").otherwise("edit")
    kind = F.when(n == 0, "message").when(n == 2, replaced).otherwise("delta")
    draft = F.when(n == 0, F.reverse(F.substring("text", F.lit(1), F.lit(chunk)))).when(n == 1, F.lit(" ... ")).otherwise(F.substring("text", (n - 2) * chunk + 1, F.lit(chunk)))
    log = seen.select("conv_id", "turn", "msg", "seq", kind.alias("kind"), F.when(n == 0, F.col("role")).alias("role"), draft.alias("text"))
    return log.repartition("conv_id", "turn", "seq")


def digests(conversations: DataFrame) -> DataFrame:
    """The figures of each conversation, taken from its rendered text."""
    back = read_back(conversations)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
