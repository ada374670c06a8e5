"""SentencePiece model files: the protobuf read field by field, and what the vocabulary says about safe places to cut."""

from __future__ import annotations

from dataclasses import dataclass, field

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
# Classes of characters that pieces hold side by side, at most: their table has the square of it.
CLASSES = 4000


@dataclass
class Model:
    pieces: list = field(default_factory=list)  # (piece, score, kind)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # remove extra white space
    escape: bool = True


def _fields(data: bytes):
    """(field number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> Model:
    """The parts of a model file that decide encoding: pieces, model kind, byte fallback and normaliser."""
    import struct

    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def separable(model: Model) -> bool:
    """Whether text can be cut before each run of spaces and around newlines without changing its tokens: the normaliser
    changes nothing but spaces, and no piece holds a space mark after another character or a newline."""
    if model.charsmap or model.squeeze or not (model.escape and model.dummy_prefix):
        return False
    return not any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def neighbours(model: Model):
    """(class of every character, table of classes that may touch): where two characters stand side by side in no piece, nothing
    merges across, so text can be cut there. Marks are spaces here. Characters outside the vocabulary stay together, since an
    unknown run may be one token; newlines stand alone. Classes are shared when there are many, which only makes cuts rarer."""
    import numpy as np

    pieces = [p.replace(MARK, " ") for p, _, kind in model.pieces if kind in (NORMAL, USER, UNUSED)]
    pairs = {p[i - 1 : i + 1] for p in pieces for i in range(1, len(p))}
    letters = sorted(set("".join(pairs)))
    size = 2 + min(len(letters), CLASSES)
    known = {p for p in pieces if len(p) == 1}
    kinds = np.ones(0x110000, np.int32)  # 0: a piece of its own and in no other, 1: unknown
    kinds[[10, *map(ord, known)]] = 0
    kinds[list(map(ord, letters))] = 2 + np.arange(len(letters)) % CLASSES
    table = np.zeros((size, size), bool)
    for a, b in pairs:
        table[kinds[ord(a)], kinds[ord(b)]] = True
    unknown = [1, *{int(kinds[ord(c)]) for c in letters if c not in known}]
    table[np.ix_(unknown, unknown)] = True
    return kinds, table


def chunks(text: str) -> list[str]:
    """``text`` as the pieces see it, cut where no piece of a separable model reaches across: before each run of marks and
    around newlines. Joined they are the marked text."""
    if not text:
        return []
    out = []
    for i, line in enumerate(text.replace(MARK, " ").split("\n")):
        if i:
            out.append("\n")
        head, *rest = line.split(" ")
        if "" not in rest and (head or i):
            if not i:
                out.append(MARK + head)
            elif head:
                out.append(head)
            out += [MARK + w for w in rest]
            continue
        run = MARK if not i else ""
        if head:
            out.append(run + head)
            run = ""
        for word in rest:
            run += MARK
            if word:
                out.append(run + word)
                run = ""
        if run:
            out.append(run)
    return out
