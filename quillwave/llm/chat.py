"""Chat formatting by rendering successive turn prefixes of a black-box template.

A template is any function from turns to text. The turns of a conversation are
rendered prefix by prefix. Where each output begins with the output before it,
the new part is the span of the new turn. Where it doesn't, the template
rewrites history: the turn is reported, and the spans found so far would no
longer hold, so the piece gets no spans and no loss mask. Where the text lies inside a span is found by rendering the turn
with two different marks as its text: both outputs agree up to the text. What
surrounds a text is kept by role and predecessor, and checked for each turn.

Control strings inside texts are escaped before rendering: a backslash goes
behind the first character of each, and one more into what already looks
escaped, so the way back is exact and other texts stay as they are.

Long conversations are rendered in pieces of ``most`` turns after the
``lookback`` turns before them, on which alone a template's text for a turn may
depend. Pieces joined in order are the formatted conversation.

Defined results: null roles and texts are empty; any role is kept. Turns with
equal numbers are ordered by their digest; repeated rows are repeated turns.
Rows of a null conversation id are one conversation. Extra columns are not
read. A text of any length is rendered whole. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm.common import arrow_schema
from quillwave.llm.turns import by_length, turns

Turn = tuple[str, str]
# Stand-ins for a text; any two strings that differ in the first character do.
_MARKS = ("\ue000", "\uf8ff")


@dataclass(frozen=True)
class Template:
    """``render`` gives the text of a list of turns; ``role_of`` reads a role from the marks before its text.

    ``closing`` is what ``render`` adds after the last turn only. ``learned``
    names the roles under the loss mask.
    """

    render: Callable[[list[Turn]], str]
    role_of: Callable[[str], str]
    controls: tuple[str, ...]
    closing: str = ""
    lookback: int = 1
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for a in self.controls:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"a control string has two characters or more and no backslash: {a!r}")
            for b in self.controls:
                if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings must not overlap: {a!r}, {b!r}")

    @cached_property
    def _patterns(self) -> tuple[str, re.Pattern, re.Pattern]:
        """First characters of control strings; what to escape and what to undo behind them."""

        def behind(slashes: str) -> re.Pattern:
            return re.compile("|".join(f"(?<={re.escape(c[0])}){slashes}(?={re.escape(c[1:])})" for c in self.controls))

        return "".join({c[0] for c in self.controls}), behind(r"\\*+"), behind(r"\\++")

    def escape(self, text: str) -> str:
        firsts, found, _ = self._patterns
        return found.sub(lambda m: "\\" + m.group(), text) if any(c in text for c in firsts) else text

    def unescape(self, text: str) -> str:
        return self._patterns[2].sub(lambda m: m.group()[1:], text) if "\\" in text else text


def instruction_marks(held: list[Turn]) -> str:
    """``[INST]`` around users, ``</s>`` after assistants, the name of any other role in its marks."""
    out = ["<s>"]
    for role, text in held:
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
        else:
            out.append(f"<<ROLE>>{role}<</ROLE>>{text}<</TURN>>")
    return "".join(out)


def instruction_role(marks: str) -> str:
    return {"[INST] ": "user", " ": "assistant"}.get(marks) or marks.removeprefix("<<ROLE>>").removesuffix("<</ROLE>>")


INSTRUCTION = Template(
    instruction_marks,
    instruction_role,
    # Control strings of common instruction formats.
    ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>", "<|im_start|>", "<|im_end|>"),
    lookback=0,
)


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Located:
    """Spans of turns in the output of a template, by comparing the outputs of successive prefixes."""

    def __init__(self, template: Template):
        self.template = template
        self.around: dict[tuple, tuple[str, str]] = {}

    def _rendered(self, held: list[Turn]) -> str:
        out = self.template.render(held)
        return out.removesuffix(self.template.closing) if self.template.closing else out

    def _surround(self, before: list[Turn], role: str, begin: int) -> tuple[str, str]:
        """What stands before and after the text of a turn inside its span."""
        one, other = (self._rendered([*before, (role, mark)]) for mark in _MARKS)
        at = common_prefix(one, other)
        return one[begin:at], one[at + len(_MARKS[0]) :]

    def __call__(self, context: list[Turn], held: list[Turn], first: bool) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
        """The text of ``held`` after ``context``; per turn span and text span in it; the turn that rewrote history.

        Roles and texts are escaped ones. The ``first`` piece also has what
        the template puts before all turns.
        """
        seen, before = list(context), self._rendered(context)
        start, spans, rewrote = 0 if first else len(before), [], None
        for number, (role, text) in enumerate(held):
            now = self._rendered([*seen, (role, text)])
            begin = len(before)
            if rewrote is None and not now.startswith(before):
                rewrote = number
            if rewrote is None:
                key = (role, seen[-1][0] if seen else None)
                head, foot = self.around.get(key, ("", ""))
                if key not in self.around or now[begin:] != f"{head}{text}{foot}":
                    head, foot = self.around[key] = self._surround(seen, role, begin)
                if now[begin:] == f"{head}{text}{foot}":
                    at = begin + len(head)
                    spans.append((begin - start, at - start, at + len(text) - start, len(now) - start))
                else:  # The template changes the text itself: the turn has a span, its text has none.
                    spans.append((begin - start, -1, -1, len(now) - start))
            seen.append((role, text))
            before = now
        return before[start:], spans if rewrote is None else [], rewrote


# Characters of output that a task gathers before it hands them on.
_FLUSH = 2_000_000
_STRUCTS = "array<struct<role:string,text:string>>"


def pieces(conversations: DataFrame, most: int, lookback: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, piece, context, turns): conversations of one piece, and the pieces of longer ones."""
    short, long = by_length(turns(conversations), most)
    pair = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = short.select(
        "conv_id", F.lit(0).cast("bigint").alias("piece"), F.array().cast(_STRUCTS).alias("context"), pair.alias("turns"), F.lit(True).alias("last")
    )
    number = F.floor(F.col("pos") / most)
    # The last turns of a piece are also the context of the next one.
    ends = (F.col("pos") % most >= most - lookback) & ((number + 1) * most < F.col("n"))
    dealt = long.withColumn("piece", F.explode(F.when(ends, F.array(number, number + 1)).otherwise(F.array(number))))
    own = F.col("pos") >= F.col("piece") * most
    item = F.struct("pos", "role", "text")
    cut = dealt.groupBy("conv_id", "piece").agg(
        F.sort_array(F.collect_list(F.when(~own, item))).alias("context"),
        F.sort_array(F.collect_list(F.when(own, item))).alias("turns"),
        (F.max("n") <= (F.max("piece") + 1) * most).alias("last"),
    )
    plain = [F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(c) for c in ("context", "turns")]
    return whole, cut.select("conv_id", "piece", *plain, "last")


_FORMATTED = (
    "conv_id bigint, piece bigint, formatted string, "
    "spans array<struct<begin:bigint,text_begin:bigint,text_end:bigint,end:bigint,loss:boolean>>, rewrote_at int"
)


def _batch(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def formatted(cut: DataFrame, template: Template) -> DataFrame:
    """One row per piece: its text, the spans of its turns in it, and the turn at which history was rewritten (else null)."""
    arrow = arrow_schema(_FORMATTED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        locate, out, size = Located(template), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                context, held = ([(template.escape(t["role"]), template.escape(t["text"])) for t in row[c]] for c in ("context", "turns"))
                text, spans, rewrote = locate(context, held, row["piece"] == 0)
                if row["last"]:
                    text += template.closing
                marked = [
                    {"begin": a, "text_begin": b, "text_end": c, "end": d, "loss": turn["role"] in template.learned and b >= 0}
                    for (a, b, c, d), turn in zip(spans, row["turns"])
                ]
                out.append((row["conv_id"], row["piece"], text, marked, rewrote))
                size += len(text)
                if size > _FLUSH:
                    yield _batch(out, arrow)
                    out, size = [], 0
        if out:
            yield _batch(out, arrow)

    return cut.mapInArrow(run, _FORMATTED)


def read_turns(text: str, spans: list[dict], template: Template) -> Iterator[tuple[str, str, bool]]:
    """(role, text, loss) of each turn, read from a formatted piece and its spans alone."""
    for span in spans:
        if span["text_begin"] >= 0:
            role = template.unescape(template.role_of(text[span["begin"] : span["text_begin"]]))
            yield role, template.unescape(text[span["text_begin"] : span["text_end"]]), span["loss"]


_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(output: DataFrame, template: Template) -> DataFrame:
    """Per conversation what is read back; the pieces of one must follow each other in order in a partition.

    Pieces pass one by one through running digests, so a conversation of any
    length takes no memory.
    """
    arrow = arrow_schema(_DIGESTS)

    def ended(running: list) -> list:
        return [v.hexdigest() if hasattr(v, "hexdigest") else v for v in running]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or row["conv_id"] != name or row["piece"] == 0:
                    if held:
                        out.append(ended(held))
                    name, held = row["conv_id"], [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[5] += len(row["formatted"])
                for role, text, loss in read_turns(row["formatted"], row["spans"], template):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                    if loss:
                        held[3] += len(text)
                        held[4].update(text.encode())
            if out:
                yield _batch(out, arrow)
                out = []
        if held:
            yield _batch([ended(held)], arrow)

    return output.mapInArrow(run, _DIGESTS)


def format_conversations(conversations: DataFrame, template: Template = INSTRUCTION, most: int = 64) -> DataFrame:
    """All conversations: (conv_id, piece, formatted, spans, rewrote_at)."""
    whole, cut = pieces(conversations, most, template.lookback)
    return formatted(whole.unionByName(cut), template)


def read_back(conversations: DataFrame, template: Template = INSTRUCTION, most: int = 64) -> DataFrame:
    """Format all conversations and give the digests of what is read back from the output.

    Only the pieces of long conversations are shuffled again, to be read in order.
    """
    whole, cut = pieces(conversations, most, template.lookback)
    ordered = formatted(cut, template).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return digests(formatted(whole, template), template).unionByName(digests(ordered, template))
