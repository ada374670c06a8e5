"""SentencePiece models encoded and decoded through the tokenizers library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docket.llm.common import CACHE_KEY, in_parts, over_texts, plain, table, worker_cache
from docket.llm.pieces import BPE, CONTROL, MARK, NORMAL, UNKNOWN, USER, neighbours, read_model, separable
from docket.llm.token_counts import model_bytes

# Parts not met before are encoded together, so many in one call.
BATCH = 4096
# Parts remembered in each of two generations: with its ids a part takes some 200 bytes.
REMEMBERED = 150_000


def build_tokenizer(data: bytes, chunked: bool = False):
    """A tokenizer rebuilt from a model file: normaliser, mark for spaces, scores or merges, byte fallback, decoder. ``chunked``:
    for chunks that are marked already, and that are no beginnings of texts: without normaliser, and no space is taken off."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    m = read_model(data)
    ids = {piece: i for i, (piece, _, _) in enumerate(m.pieces)}
    unknown = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
    if m.kind == BPE:
        usable = {piece: score for piece, score, kind in m.pieces if kind in (NORMAL, USER)}
        pairs = []
        for piece, score in usable.items():
            for i in range(1, len(piece)):
                left, right = piece[:i], piece[i:]
                if left in usable and right in usable:
                    pairs.append((-score, ids[left], ids[right], left, right))
        pairs.sort()
        core = models.BPE(
            vocab=ids, merges=[p[3:] for p in pairs], unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback
        )
    else:
        core = models.Unigram([(piece, score) for piece, score, _ in m.pieces], unknown, m.byte_fallback)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    if steps and not chunked:
        tokenizer.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix and not chunked else []))
    return tokenizer


class Codec:
    """Encodes and decodes whole texts; ids travel as little-endian 32-bit integers.

    For a separable model texts are cut wherever no piece reaches across. The rebuilt tokenizer encodes, and decodes, each
    distinct part once, many parts in one call as the lines of a text, and a text is the joined ids, or texts, of its parts. Every
    distinct part is encoded by the sentencepiece library as well, to compare: where its ids differ the part counts as a miss,
    and texts that hold it do not agree. Other models are encoded and decoded text by text, and compared the same way."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = read_model(data)
        self.tokenizer = build_tokenizer(data)
        self.chunk_tokenizer = build_tokenizer(data, chunked=True)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        # Parts become lines, so a newline has to be a token of its own and none that stands for anything else.
        self.line = self._own("\n")
        alone = self.model.byte_fallback or "\n" in {piece for piece, _, _ in self.model.pieces}
        self.by_part = separable(self.model) and alone and len(self.line) == 1
        self.kinds, self.touch = neighbours(self.model) if self.by_part else (None, None)
        self.ids: dict[bytes, bytes] = {}  # by part, with spaces for marks
        self.old: dict[bytes, bytes] = {}
        self.odd: set[bytes] = set()
        self.other: dict[bytes, str] = {}  # what the ids decode to, where it is not the part itself
        self.silent = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}

    def _own(self, text: str) -> list[int]:
        return self.chunk_tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, texts: list[str]):
        """(distinct parts, which of them each part is, first part of every text and the end), in numpy and Arrow."""
        import numpy as np
        import pyarrow as pa

        joined = "".join([" " + t if t else "" for t in texts]).replace(MARK, " ")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.cumsum([0] + [len(t) + 1 if t else 0 for t in texts])
        kinds = self.kinds[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.touch.ravel()[kinds[:-1] * len(self.touch) + kinds[1:]]
        cut[first] = True
        at = np.nonzero(cut)[0]
        data, begins = joined.encode(), at
        if len(data) > len(points):
            begins = np.concatenate([[0], np.cumsum((points > 0x7F).view(np.int8) + (points > 0x7FF) + (points > 0xFFFF) + 1, dtype=np.int64)])[at]
        buffers = [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(data)]
        found = pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers).dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(at, first)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of parts; the parts that the libraries encode differently, and those that are not restored, are noted."""
        import numpy as np

        # The original library marks and prefixes texts itself. After a newline, which is two fixed tokens, a part keeps
        # its own spaces, so both see the same.
        skip, line, out = len(self.original.encode("\n")), self.line[0], []
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            texts = [p.decode() for p in part]
            joined = "\n".join(texts)
            own = self._own(joined.replace(" ", MARK))
            theirs = self.original.encode("\n" + joined)[skip:]
            back = self.chunk_tokenizer.decode(own, skip_special_tokens=False)
            ids = np.array(own, "<i4")
            ends = np.append(np.nonzero(ids == line)[0], len(ids))
            if len(ends) == len(part) and own == theirs and back == joined:
                data = ids.tobytes()
                out += [data[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]
                continue
            for p, text in zip(part, texts):  # a newline itself, or something differs
                mine = self._own(text.replace(" ", MARK))
                if mine != self.original.encode("\n" + text)[skip:]:
                    self.odd.add(p)
                if (back := self.chunk_tokenizer.decode(mine, skip_special_tokens=False)) != text:
                    self.other[p] = back
                out.append(np.array(mine, "<i4").tobytes())
        return out

    def _known(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts, those met before from memory."""
        if len(self.ids) > REMEMBERED:
            self.old, self.ids = self.ids, {}
            self.odd.intersection_update(self.old)
            self.other = {p: text for p, text in self.other.items() if p in self.old}
        found = list(map(self.ids.get, parts))
        new = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if (ids := self.old.get(parts[i])) is None:
                new.append(i)
            else:
                found[i] = self.ids[parts[i]] = ids
        for i, ids in zip(new, self._learn([parts[i] for i in new])):
            found[i] = ids
            if len(parts[i]) <= CACHE_KEY:
                self.ids[parts[i]] = ids
        return found

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, str]]:
        """(ids, whether both libraries agree, what the ids decode to) of each text."""
        import numpy as np

        if not self.by_part:
            own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.original.encode(texts, num_threads=1)
            return [(np.array(a, "<i4").tobytes(), a == b, t) for a, b, t in zip(own, theirs, self.decode(own))]
        return [row for low, high in in_parts(texts) for row in self._encode(texts[low:high])]

    def _encode(self, texts: list[str]) -> list[tuple[bytes, bool, str]]:
        import numpy as np

        parts, which, first = self._parts(texts)
        known = self._known(parts)
        flat = np.frombuffer(b"".join(known), "<i4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins, many = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(begins - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        holds = lambda some: self._holding(parts, which, first, some)
        odd, other = holds(self.odd), holds(self.other)
        out = []
        for i, (text, a, b) in enumerate(zip(texts, ends[first[:-1]].tolist(), ends[first[1:]].tolist())):
            back = text.replace(MARK, " ")
            if other[i]:
                held = (parts[j] for j in which[first[i] : first[i + 1]])
                back = self._first("".join([self.other[p] if p in self.other else p.decode() for p in held]))
            out.append((ids[4 * a : 4 * b], not odd[i], back))
        return out

    def _holding(self, parts: list[bytes], which, first, some) -> list[bool]:
        """Which texts hold one of some parts."""
        import numpy as np

        if not some or not any(p in some for p in parts):
            return [False] * (len(first) - 1)
        so_far = np.concatenate([[0], np.cumsum(np.array([p in some for p in parts])[which])])
        return (so_far[first[1:]] > so_far[first[:-1]]).tolist()

    def _first(self, text: str) -> str:
        """A text put together from chunks, less the space that the model puts in front."""
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def decode(self, each: list[list[int]]) -> list[str]:
        """Texts of lists of ids, by the rebuilt tokenizer; control pieces are silent."""
        silent = self.silent
        return self.tokenizer.decode_batch([[i for i in ids if i not in silent] for ids in each], skip_special_tokens=False)


def codec(data: bytes) -> Codec:
    return worker_cache(f"codec_{hash(data)}", lambda: Codec(data))


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, agrees, restored): the token ids of every whole text by the rebuilt tokenizer,
    whether the sentencepiece library gives the same, and whether decoding the ids gives the text back. One pass, no shuffle; rows as in ``token_counts``. A text
    that holds the space mark itself decodes to a space and is not restored."""
    return _pass(docs, model, False)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """``encode`` with a hash in place of the ids: (doc_id, n_tokens, ids_sha256, agrees, restored), the hash being that of
    the ids as little-endian 32-bit integers."""
    return _pass(docs, model, True)


def _pass(docs: DataFrame, model: bytes, hashed: bool) -> DataFrame:
    def make():
        import hashlib

        import numpy as np
        import pyarrow as pa

        c = codec(model)

        def work(batch: dict) -> dict:
            texts = batch["text"]
            done = c.encode(texts)
            out = {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(ids) // 4 for ids, _, _ in done],
                "agrees": [same for _, same, _ in done],
                "restored": [back == text for (_, _, back), text in zip(done, texts)],
            }
            if hashed:
                out["ids_sha256"] = [hashlib.sha256(ids).hexdigest() for ids, _, _ in done]
            else:
                ends = np.concatenate([[0], np.cumsum(out["n_tokens"])]).astype("int32")
                flat = np.frombuffer(b"".join(ids for ids, _, _ in done), "<i4")
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            return out

        return work

    what = "ids_sha256 string" if hashed else "ids array<int>"
    return over_texts(plain(docs), make, f"doc_id long, n_tokens long, {what}, agrees boolean, restored boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give empty text."""

    def make():
        c = codec(model)

        def work(batch: dict) -> dict:
            return {"doc_id": batch["doc_id"], "text": c.decode([ids or [] for ids in batch["ids"]])}

        return work

    return over_texts(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the 32k piece model: counts, hash of the ids, agreement and round trip."""
    return digests(table(spark, sf_dir, "documents"), model_bytes())
