"""Token counts by heap-and-linked-list byte-pair merging, without token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docket.llm.common import Memo, over_texts, plain, table, worker_cache
from docket.llm.pieces import BPE, NORMAL, UNUSED, USER, chunks, read_model, separable

MODEL_FILE = "piece_bpe_32k.model"
CONTEXT = 4096
MEMO = 350_000  # chunks remembered per generation of a worker's memo: a merge costs more than a look


def ranks_of(data: bytes) -> dict[str, float]:
    """Rank of every piece that merging can make: the lower, the earlier."""
    model = read_model(data)
    if model.kind != BPE or not separable(model) or any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("needs a byte-pair model with plain spaces and no user-defined pieces")
    return {piece: -score for piece, score, kind in model.pieces if kind in (NORMAL, UNUSED)}


def merged_count(chunk: str, ranks: dict[str, float]) -> int:
    """Tokens of one chunk: its symbols less the merges made, plus the further bytes of symbols outside the vocabulary.

    The heap holds (rank, place of the left symbol, left, right) of adjacent pairs; symbols form a doubly linked list. The
    lowest rank merges first, the leftmost of equal ones; an entry whose symbols have changed since is passed over."""
    from heapq import heapify, heappop, heappush

    get, symbols = ranks.get, list(chunk)
    n = len(symbols)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = enumerate(zip(symbols, symbols[1:]))
    heap = [(rank, i, a, b) for i, (a, b) in pairs if (rank := get(a + b)) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = ahead[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        made = symbols[i] = left + right
        symbols[j] = ""
        k = ahead[i] = ahead[j]
        if k < n:
            behind[k] = i
            rank = get(made + symbols[k])
            if rank is not None:
                heappush(heap, (rank, i, made, symbols[k]))
        h = behind[i]
        if h >= 0:
            rank = get(symbols[h] + made)
            if rank is not None:
                heappush(heap, (rank, h, symbols[h], made))
        merges += 1
    unknown = sum(len(s.encode()) - 1 for s in symbols if s and s not in ranks)
    return n - merges + unknown


def counter(data: bytes):
    """chunk -> token count, remembered per worker. A chunk is first cut between characters that stand side by side in no
    piece, since nothing merges across, so that `word,` and `word` share their work."""

    def build():
        ranks = ranks_of(data)
        touching = {a + b for piece in ranks for a, b in zip(piece, piece[1:])}

        def count(chunk):
            parts, start = [], 0
            for i in range(1, len(chunk)):
                if chunk[i - 1 : i + 1] not in touching:
                    parts.append(chunk[start:i])
                    start = i
            return sum(counts[p] for p in (*parts, chunk[start:])) if parts else merged_count(chunk, ranks)

        counts = Memo(count, MEMO)
        return counts

    return worker_cache(f"token_counts_{hash(data)}", build)


def token_counts(docs: DataFrame, model: bytes, limit: int = CONTEXT) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    One pass, no shuffle. Null text is empty and has no bytes and no tokens; null and repeated ids give a row each; other
    columns are ignored; an empty table gives no rows."""

    def make():
        counts = counter(model)

        def work(batch: dict) -> dict:
            n_bytes, n_tokens = [], []
            for text in batch["text"]:
                n_bytes.append(len(text.encode()))
                n_tokens.append(sum(map(counts.__getitem__, chunks(text))))
            return {"doc_id": batch["doc_id"], "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]}

        return work

    return over_texts(plain(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def model_bytes(name: str = MODEL_FILE) -> bytes:
    """The vocabulary file, read once on the driver; about half a megabyte goes to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32k piece vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), model_bytes())
