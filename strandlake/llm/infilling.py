"""Fill-in-the-middle: texts cut at two token ranks and put in another order, from a sparse scan of where the class of characters changes."""

from __future__ import annotations

import string
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plus, with_text

#: What marks the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
BEGINS, ENDS, SENTINEL = 0, 1, 2


@cache
def automaton(sentinels: tuple[str, ...] = SENTINELS):
    """One Aho-Corasick automaton for every pair of ASCII characters in which a run of letters begins or ends, and for the sentinels."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for letter in string.ascii_letters:
        for other in set(map(chr, range(128))) - set(string.ascii_letters):
            found.add_word(other + letter, BEGINS)
            found.add_word(letter + other, ENDS)
    for word in sentinels:
        found.add_word(word, SENTINEL)
    found.make_automaton()
    return found


class Ranks:
    """Tokens (``[A-Za-z]+|[^A-Za-z]``) of a text, counted and found by rank without listing them.

    Only the places where a run of letters begins or ends are kept, eight bytes each. Between two of them the count of
    tokens is arithmetic: a run is one token, anything else one for each code point.
    """

    def __init__(self, text: str, sentinels: tuple[str, ...] = SENTINELS):
        # Every code point beyond ASCII becomes one "?": no letter, and no part of a sentinel.
        flat = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        events = np.fromiter((3 * end + kind for end, kind in automaton(sentinels).iter(flat)), np.int64)
        kinds = events % 3
        self.size = len(text)
        self.sentinel = bool((kinds == SENTINEL).any())
        begins, ends = events[kinds == BEGINS] // 3, events[kinds == ENDS] // 3
        if flat and flat[0] in string.ascii_letters:
            begins = np.concatenate([[0], begins])
        if flat and flat[-1] in string.ascii_letters:
            ends = np.concatenate([ends, [self.size]])
        spared = np.cumsum(ends - begins - 1)
        self.ends = ends
        self.begins = begins
        self.first = begins - np.concatenate([[0], spared[:-1]]) if len(begins) else begins
        self.n = self.size - (int(spared[-1]) if len(spared) else 0)

    def offset(self, rank: int) -> int:
        """The code point at which the token of this rank begins; the text's length for rank ``n``."""
        i = int(np.searchsorted(self.first, rank, "right")) - 1
        if i < 0:
            return rank
        over = rank - int(self.first[i])
        return int(self.ends[i]) + over - 1 if over else int(self.begins[i])


def draws(doc_id, seed: str) -> list[int]:
    """Four unsigned numbers of 32 bits from the hash of ``seed:doc_id``; of nothing after the colon for a null id."""
    import hashlib

    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def infilled(text: str, doc_id, seed: str, percent: int, spm_percent: int, sentinels: tuple[str, ...]) -> tuple[str, int, str, int | None, int | None]:
    """The transformed text, its number of tokens, its form, and the code points of prefix and middle (None if plain)."""
    ranks = Ranks(text, sentinels)
    one, two, kind, order = draws(doc_id, seed)
    if not text or ranks.sentinel or kind % 100 >= percent:
        return text, ranks.n, "plain", None, None
    lo, hi = (ranks.offset(x) for x in sorted((one % (ranks.n + 1), two % (ranks.n + 1))))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    p, s, m = sentinels
    if order % 100 < spm_percent:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", ranks.n, "spm", lo, hi - lo
    return f"{p}{prefix}{s}{suffix}{m}{middle}", ranks.n, "psm", lo, hi - lo


def fill_in_middle(docs: DataFrame, seed: str = "1", percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with ``infill`` (the transformed text), ``n_tokens``, ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars``.

    ``percent`` of the texts are transformed, ``spm_percent`` of these with the suffix first; cuts and form depend on
    ``seed`` and ``doc_id`` only, so reruns agree, and rows that share a ``doc_id`` are drawn alike. Null text counts as
    empty; an empty text, or one that has a sentinel, stays plain. A null ``doc_id`` draws as an id without digits. Two
    equal cuts leave an empty middle. Texts are read whole and where they lie, nothing is dealt out; a very long text
    takes eight bytes for each place where letters begin or end. Columns of the new names are replaced, others pass
    through. Empty table: empty result.
    """
    marks = tuple(sentinels)

    def make_all(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id")).to_pylist()

            def make(texts, ids=ids):
                rows = [infilled((t or b"").decode(), i, seed, percent, spm_percent, marks) for t, i in zip(texts, ids)]
                kinds = {"infill": pa.string(), "n_tokens": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
                return {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())}

            yield from with_text([batch], make)

    return docs.mapInArrow(make_all, plus(docs, "infill string, n_tokens long, form string, prefix_chars long, middle_chars long"))


def restored(infill, form, sentinels: tuple[str, str, str] = SENTINELS):
    """Column: the text that ``fill_in_middle`` made ``infill`` of. No sentinel can begin in a text and end in a mark beside it, or the other way round, so splitting at the marks is exact."""
    parts = F.split(infill, "|".join(f"\\Q{x}\\E" for x in sentinels), -1)
    psm, spm = (1, 3, 2), (2, 3, 1)
    joined = [F.concat(*(F.get(parts, F.lit(i)) for i in order)) for order in (psm, spm)]
    return F.when(form == "psm", joined[0]).when(form == "spm", joined[1]).otherwise(infill)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document transformed: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select(
        "doc_id",
        F.col("n_tokens").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("infill", 256).alias("output_sha256"),
        F.sha2(restored(F.col("infill"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH token AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM token
), cut AS (
  SELECT doc_id, text, n, t, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), part AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:lo], '') AS p, array_to_string(t[lo + 1:hi], '') AS m, array_to_string(t[hi + 1:], '') AS s
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM part
"""
