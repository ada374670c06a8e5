"""Personal data by pattern, and terms that give it away by how often they stand beside it in the corpus."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm.common import KEY, Words, in_parts, over_partition, over_texts, plain, row_key, same_row, table
from docket.llm.decontaminate import bit_filter, passing
from docket.session import stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
EMAIL = re.compile(rf"[{LOCAL}]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"\w+")
NEAR = 8  # words to each side of an entity that stand beside it
GENERALISE, REMOVE = 0.5, 0.8  # part of an entity's information that a term may disclose


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches. A match begins where a run of local characters begins, or where the last match ended within one, so
    other places of the run are not tried and long runs cost one pass."""
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found.start(), found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start: leftmost non-overlapping matches per kind less those that fail
    their check."""
    out = [("email", s, e) for s, e in emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def entity(kind: str, text: str) -> str:
    """What a span names, however it is written."""
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', text)}"


def surroundings(docs: DataFrame) -> DataFrame:
    """(doc row key, entity, around, terms): for each entity span the words beside it, other entities left out, and a hash of
    them that tells different surroundings apart."""

    def make():
        import xxhash

        def work(batch: dict) -> dict | None:
            out = {k: [] for k in (*KEY, "entity", "around", "terms")}
            for row, text in enumerate(batch["text"]):
                found = base_spans(text)
                if not found:
                    continue
                taken = [(s, e) for _, s, e in found]
                words = [(m.start(), m.end()) for m in TERM.finditer(text) if not any(s < m.end() and m.start() < e for s, e in taken)]
                starts = [s for s, _ in words]
                from bisect import bisect_left

                for kind, s, e in found:
                    at = bisect_left(starts, s)
                    terms = [text[a:b].lower() for a, b in words[max(0, at - NEAR) : at + NEAR]]
                    for k in KEY:
                        out[k].append(batch[k][row])
                    out["entity"].append(entity(kind, text[s:e]))
                    out["around"].append(xxhash.xxh3_64_intdigest(" ".join(terms)) - 2**63)
                    out["terms"].append(sorted(set(terms)))
            return out if out["around"] else None

        return work

    keyed = plain(docs).select(*row_key(), "text")
    return over_texts(keyed, make, "doc_id long, h1 long, h2 long, entity string, around long, terms array<string>")


def hashed(terms: DataFrame) -> DataFrame:
    """(hash) of each term."""

    def make():
        import numpy as np

        def work(batch: dict) -> dict:
            each = [Words([t]).hashes for t in batch["term"]]
            return {"hash": [int(h.view(np.int64)[0]) if len(h) else 0 for h in each]}

        return work

    return over_texts(terms, make, "hash long")


def known_words(texts: list[str], maps):
    """(place of a text, its words that pass the filter) for the texts that have some."""
    import numpy as np

    for a, b in in_parts(texts):
        found = Words(texts[a:b])
        near = passing(maps, found.hashes)
        text_of = np.searchsorted(found.first, near, side="right") - 1
        for row in np.unique(text_of):
            yield a + int(row), {found.texts(i, i + 1)[0] for i in near[text_of == row]}


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents): in how many texts each of the given terms stands, over all texts."""

    marks = bit_filter(hashed(terms), "hash")

    def make():
        import numpy as np
        from collections import Counter

        maps = [np.frombuffer(m, np.uint8) for m in marks.value]
        counts: Counter = Counter()

        def step(batch: dict) -> None:
            for _, words in known_words(batch["text"], maps):
                counts.update(words)

        return step, lambda: {"term": list(counts), "documents": list(counts.values())}

    counted = over_partition(plain(docs).select("text"), make, "term string, documents long")
    return counted.groupBy("term").agg(F.sum("documents").alias("documents")).join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, least: float = GENERALISE) -> DataFrame:
    """(term, entity, disclosed): terms that disclose at least ``least`` of an entity's information.

    With p over documents, a term t discloses PMI(t; e) / IC(e) = log(p(t, e) / (p(t) p(e))) / -log p(e) of entity e: 1 where t
    stands nowhere without e beside it, 0 where they are independent. That is shrunk by 1 - 1 / s^2 for s different surroundings
    that they share: copies of one text are no evidence, two surroundings suffice to generalise a term seen nowhere else, three
    to remove it. The strongest entity of each term counts."""
    beside = stored(surroundings(docs))
    n = plain(docs).count()
    whole = beside.select(*KEY, "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = beside.select(*KEY, "entity", "around", F.explode("terms").alias("term"))
    # Different surroundings first, then documents: two plain counts instead of a distinct count over a hot pair.
    kinds = pairs.select("entity", "term", "around").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = kinds.filter("kinds > 1")  # one surrounding discloses nothing
    both = pairs.select(*KEY, "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    met = stored(kinds.join(both, ["entity", "term"]))
    terms = document_counts(docs, met.select("term").distinct())
    facts = met.join(whole, "entity").join(terms, "term")
    # Rows of one id and text count once beside entities and as often as they are repeated in the corpus.
    pmi = F.log(F.col("n_te") * F.lit(float(max(n, 1))) / (F.greatest("documents", "n_te") * F.col("n_e")))
    borne_out = 1 - 1 / (F.col("kinds") * F.col("kinds"))
    disclosed = F.when(F.col("n_e") >= n, F.lit(0.0)).otherwise(borne_out * pmi / F.log(F.lit(float(max(n, 1))) / F.col("n_e")))
    rated = facts.select("term", F.struct(disclosed.alias("disclosed"), "entity").alias("best")).filter(disclosed >= least)
    return rated.groupBy("term").agg(F.max("best").alias("best")).select("term", "best.entity", "best.disclosed")


def term_spans(docs: DataFrame, terms: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(row key, added): where the given terms stand in each text, as (kind, start, end), ``removed`` for terms that disclose at
    least ``remove`` and ``general`` for others. Terms meet words in a join; a filter of fixed size keeps other words out of it."""

    terms = stored(terms)
    marks = bit_filter(hashed(terms.select("term")), "hash")

    def make():
        import numpy as np

        maps = [np.frombuffer(m, np.uint8) for m in marks.value]

        def work(batch: dict) -> dict | None:
            out = {k: [] for k in (*KEY, "term", "start", "end")}
            for row, known in known_words(batch["text"], maps):
                for m in TERM.finditer(batch["text"][row]):
                    if (word := m.group().lower()) in known:
                        for k in KEY:
                            out[k].append(batch[k][row])
                        out["term"].append(word)
                        out["start"].append(m.start())
                        out["end"].append(m.end())
            return out if out["term"] else None

        return work

    keyed = plain(docs).select(*row_key(), "text")
    places = over_texts(keyed, make, "doc_id long, h1 long, h2 long, term string, start int, end int")
    kind = F.when(F.col("disclosed") >= remove, "removed").otherwise("general").alias("kind")
    rated = places.join(terms, "term").select(*KEY, F.struct(kind, "start", "end").alias("span"))
    return rated.groupBy(*KEY).agg(F.array_sort(F.collect_set("span")).alias("added"))


def personal_data(docs: DataFrame, least: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(row key, text, base, added, entities), one row per row of ``docs``: the spans found by pattern, those of disclosing terms,
    both as arrays of (kind, start, end) in code points.

    Null text is empty and has no spans; repeated rows get the same spans each; other columns are ignored; an empty table gives no rows. A term is looked for in
    every text, whether or not its entity stands there."""
    added = term_spans(docs, disclosing_terms(docs, least), remove)

    def make():
        def work(batch: dict) -> dict:
            base = [[{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t)] for t in batch["text"]]
            return {k: batch[k] for k in (*KEY, "text")} | {"base": base}

        return work

    keyed = plain(docs).select(*row_key(), "text")
    shape = "array<struct<kind:string,start:int,end:int>>"
    based = over_texts(keyed, make, f"doc_id long, h1 long, h2 long, text string, base {shape}")
    return same_row(based, added).withColumn("added", F.coalesce("added", F.array().cast(shape)))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with base spans replaced by their kind in brackets, removed terms left out and others generalised to
    ``[term]``. Where spans overlap the one that starts first, then the longer, holds."""
    found = personal_data(docs)

    def make():
        def work(batch: dict) -> dict:
            texts = []
            for text, base, added in zip(batch["text"], batch["base"], batch["added"]):
                out, at = [], 0
                for s in sorted([*base, *added], key=lambda x: (x["start"], -x["end"])):
                    if s["start"] >= at:
                        put = {"removed": "", "general": "[term]"}.get(s["kind"], f"[{s['kind']}]")
                        out += [text[at : s["start"]], put]
                        at = s["end"]
                texts.append("".join([*out, text[at:]]))
            return {"doc_id": batch["doc_id"], "text": texts}

        return work

    return over_texts(found.select("doc_id", "text", "base", "added"), make, "doc_id long, text string")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the spans by pattern, all spans with those of disclosing terms."""
    found = personal_data(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans")
    )
