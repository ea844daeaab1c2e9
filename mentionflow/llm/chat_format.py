"""Chat formatting: typed content parts flattened by a visitor into one marked-up text.

A turn is ``<|turn|>`` role ``<|text|>`` content ``<|end|>``. Content is a list of parts: text, or
an image, audio clip or document, which leaves a placeholder in the text, a reference among the
attachments and the number of tokens it will be expanded to. Control strings inside texts and
roles, and the escape character, get the escape character before them, so reading back is exact.

The loss mask is a list of spans, in code points, over the text parts of assistant turns.

A conversation becomes one row, so it is gathered by its id; conversations are sorted by turn, then
by role and text where turns tie. Defined results: null texts, roles and parts read back as empty;
rows with a null id form one conversation; repeated rows are repeated turns; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Control strings of other widespread templates, which texts must not smuggle in.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
_CONTROL = "|".join(re.escape(c) for c in (TURN, TEXT, END, *PLACEHOLDERS.values(), *FOREIGN))
_TO_ESCAPE = re.compile(f"{_CONTROL}|{re.escape(ESCAPE)}")
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_TOKENS = re.compile(f"{re.escape(ESCAPE)}.|{_CONTROL}", re.DOTALL)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<turn:int,kind:string,ref:string,tokens:bigint>"
SPAN = "struct<start:int,end:int>"


@dataclass(frozen=True)
class Costs:
    """How many tokens an attachment is expanded to."""

    patch: int = 28  # pixels, of an image
    per_second: float = 25.0
    per_page: int = 512


def escaped(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: ESCAPE + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the turns and parts of a conversation in order."""

    costs: Costs = Costs()
    pieces: list[str] = field(default_factory=list)
    at: int = 0
    turn: int = -1
    learn: bool = False
    spans: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def visit_turn(self, role: str | None, parts: list[dict | None]) -> None:
        self.turn += 1
        self.learn = role == "assistant"
        self.put(f"{TURN}{escaped(role or '')}{TEXT}")
        for part in parts:
            kind = (part or {}).get("type") or "text"
            visit = getattr(self, f"visit_{kind}", None)
            if visit is None:
                raise ValueError(f"unknown kind of part: {kind!r}")
            visit(part or {})
        self.put(END)

    def visit_text(self, part: dict) -> None:
        start = self.at
        self.put(escaped(part.get("text") or ""))
        if self.learn:
            self.spans.append({"start": start, "end": self.at})

    def visit_image(self, part: dict) -> None:
        sides = [math.ceil((part.get(side) or 0) / self.costs.patch) for side in ("width", "height")]
        self._attach("image", part, max(1, sides[0] * sides[1]))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.costs.per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.costs.per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.put(PLACEHOLDERS[kind])
        self.attachments.append({"turn": self.turn, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders of attachments are no text."""
    turns, role, begin = [], None, 0
    buffer: list[str] = []
    for m in _TOKENS.finditer(formatted):
        mark = m[0]
        if mark[0] == ESCAPE:
            continue
        buffer.append(unescaped(formatted[begin : m.start()]))
        begin = m.end()
        if mark == TURN:
            buffer = []
        elif mark == TEXT:
            role, buffer = "".join(buffer), []
        elif mark == END:
            turns.append((role, "".join(buffer)))
    return turns


def _conversations(df: DataFrame, conv_id: str, turn: str, role: str, content: Column) -> DataFrame:
    rows = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(
        F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), content.alias("content"),
    ).alias("row"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def formatted(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    parts: str | None = None, costs: Costs = Costs(),
) -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_spans, attachments and attachment_tokens.

    ``parts`` names a column of typed parts, an array of PART; else ``text`` is the one part."""
    content = F.col(f"`{parts}`").cast(f"array<{PART}>") if parts else F.col(f"`{text}`").cast("string")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, attachments, tokens = [], [], [], []
            for rows in batch["rows"].to_pylist():
                visitor = Flattener(costs)
                for row in rows:
                    inside = row["content"]
                    visitor.visit_turn(row["role"], (inside or []) if parts else [{"type": "text", "text": inside}])
                texts.append("".join(visitor.pieces))
                spans.append(visitor.spans)
                attachments.append(visitor.attachments)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
            arrays = [
                batch["conv_id"], pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(attachments, pa.list_(pa.struct([("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
                pa.array(tokens, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "formatted", "loss_spans", "attachments", "attachment_tokens"])

    rows = _conversations(df, conv_id, turn, role, content)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        task, f"conv_id {kind}, formatted string, loss_spans array<{SPAN}>, attachments array<{ATTACHMENT}>, attachment_tokens long"
    )


def read_back(df: DataFrame) -> DataFrame:
    """What ``formatted`` holds, from its output alone: conv_id, turns, loss_text, formatted_chars."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["formatted"].to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parsed(text)] for text in texts]
            loss = [
                "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                for text, spans in zip(texts, batch["loss_spans"].to_pylist(), strict=True)
            ]
            arrays = [
                batch["conv_id"], pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                pa.array(loss, pa.string()), pa.array(map(len, texts), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turns", "loss_text", "formatted_chars"])

    kind = df.schema["conv_id"].dataType.simpleString()
    return df.select("conv_id", "formatted", "loss_spans").mapInArrow(
        task, f"conv_id {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long"
    )
