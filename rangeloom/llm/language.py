"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text yields longest matches. A
text is parsed greedily into phrases, each the longest that occurs in the
language's text (a letter that never occurs is a phrase by itself). A phrase costs
the bits of a position in the language's text, a letter that never occurs those of any
character there is; bits per letter estimate the cross entropy, and the language
with the fewest wins.

Texts are lower-cased and every run of other characters than letters and their marks counts as one
space. A whole text is one parse. Stretches of it advance together in array operations, each as
if it began a phrase; then those whose predecessor ended within a phrase are
parsed again from there, up to where both parses meet.

The labelled text is a bounded sample (``letters_in_all`` letters, shared by
the languages, ``LEAST_LETTERS`` for each at least): different texts drawn by hash at a rate that corpus counts set, one
stretch of a text each.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.workers import held
from rangeloom.operators.names import fresh
from rangeloom.operators.staging import stage

LETTERS_IN_ALL, LEAST_LETTERS = 160_000, 4_000
STRETCH = 500
UNDETERMINED = "und"
_STEP = 512
_LANES = 2048
_DENSE = 1 << 24
_PIECE, _PRIOR_PIECES, _FAR = 64, 32, 6.0
_LETTER_BITS = float(np.log2(0x110000))


def held_out(doc_id: Column) -> Column:
    """True for the documents that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """1 for each letter, 2 for each mark, 0 for the other characters."""
    return np.fromiter(({"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def cleaned(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes): characters of all texts end to end and their number in each.

    Lower case, each run of characters that are neither letters nor marks as one space, none at either end; nothing of a text without a letter.
    """
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, of = _kinds()[codes], np.repeat(np.arange(len(low)), sizes)
    with_letter = np.bincount(of[kinds == 1], minlength=len(low)) > 0
    at = np.flatnonzero((kinds > 0) & with_letter[of])
    gap = np.flatnonzero((np.diff(at) > 1) & (of[at[1:]] == of[at[:-1]])) + 1
    return np.insert(codes[at], gap, ord(" ")), np.bincount(of[at], minlength=len(low)) + np.bincount(of[at[gap]], minlength=len(low))


def letters(text: str) -> str:
    """One text as ``cleaned`` has it."""
    return cleaned([text])[0].tobytes().decode("utf-32-le", "surrogatepass")


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of each state of the automaton that reads every substring of ``text``; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class ParseTable:
    """Steps of an automaton over the letters of its own text; the next to last symbol is any other letter, the last is none.

    A step is the next state times 4, plus the phrases that it ends. Small alphabets have a row for each state;
    wide ones keep only the transitions that exist, hashed, as all others are those of the start.
    """

    def __init__(self, text: str, dense: int = _DENSE):
        moves = suffix_automaton(text)
        self.alphabet = {c: i for i, c in enumerate(sorted(moves[0]))}
        self.width = len(self.alphabet) + 2
        start = np.full(self.width, 2, np.int64)
        for c, to in moves[0].items():
            start[self.alphabet[c]] = to * 4 + 1
        self.start = start
        kept = np.array([(state * self.width + self.alphabet[c], to * 4) for state, out in enumerate(moves) for c, to in out.items()], np.int64).reshape(-1, 2)
        self.table = None
        if len(moves) * self.width <= dense:
            table = np.tile(start, (len(moves), 1))
            table[0] = start - 1
            table.ravel()[kept[:, 0]] = kept[:, 1]
            table[:, -1] = np.arange(len(moves)) * 4
            self.table = ((table >> 2) * self.width * 4 + (table & 3)).ravel().astype(np.int32)
            return
        self.shift = np.uint64(64 - max(4, (len(kept) * 4).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.probes = 0
        self.keys, self.next = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        left, at = np.arange(len(kept)), self._slot(kept[:, 0])
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = kept[left[free], 0]
            put = self.keys[at] == kept[left, 0]
            self.next[at[put]] = kept[left[put], 1]
            left, at = left[~put], (at[~put] + 1) % slots
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The steps that states take with a symbol each; a quarter of a step is its next state."""
        if self.table is not None:
            return self.table.take(state + row)
        key = state * self.width + row
        move, at = self.start[row] - (state == 0), self._slot(key)
        for _ in range(self.probes):
            hit = self.keys[at] == key
            move[hit] = self.next[at[hit]]
            at = (at + 1) % len(self.keys)
        return move

    def run(self, symbols: np.ndarray, live: list[int], after: np.ndarray, carry: int) -> tuple[np.ndarray, np.ndarray]:
        """(ended, state at the end) of each lane; the first ``live`` lanes take each step.

        ``after`` has the lane that each lane goes on from, -1 for one that begins a text and -2 for one that goes on from state ``carry``.
        """
        kind = np.int64 if self.table is None else np.int32
        moves = np.zeros(symbols.shape, kind)
        state = np.zeros(symbols.shape[1], kind)
        for t, n in enumerate(live):
            moves[t, :n] = self.step(state[:n], symbols[t, :n])
            np.right_shift(moves[t, :n], 2, out=state[:n])
        begun = np.zeros(len(state), kind)
        depth = np.searchsorted(-np.array(live), -np.arange(1, len(state) + 1), side="right")
        while True:
            want = np.where(after >= 0, state[np.maximum(after, 0)], np.where(after == -2, carry, 0)).astype(kind)
            lanes = np.flatnonzero(want != begun)
            if not len(lanes):
                return (moves & 3).sum(axis=0), state
            begun[lanes] = now = want[lanes]
            for t in range(len(live)):
                move = self.step(now, symbols[t, lanes])
                apart = (move >> 2) != (moves[t, lanes] >> 2)
                moves[t, lanes] = move
                last = apart & (depth[lanes] == t + 1)
                state[lanes[last]] = move[last] >> 2
                go = apart & ~last
                lanes, now = lanes[go], move[go] >> 2
                if not len(lanes):
                    break


class Parser:
    """Cross-parsing of texts against a sample of each language."""

    def __init__(self, samples: tuple[tuple[str, str], ...], dense: int = _DENSE):
        self.languages = [name for name, _ in samples]
        self.tables = [ParseTable(text, dense) for _, text in samples]
        self.bits = np.array([np.log2(max(2, len(text))) for _, text in samples])
        letters_of = sorted(set().union(*(t.alphabet for t in self.tables)))
        self.codes = np.full(0x110000, len(letters_of), np.int32)
        self.codes[[ord(c) for c in letters_of]] = np.arange(len(letters_of))
        #: For each language: its own symbol of each code, then of other letters and of none.
        self.own = [np.array([*(t.alphabet.get(c, t.width - 2) for c in letters_of), t.width - 2, t.width - 1], np.int32) for t in self.tables]

    def parsed(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language, and those of them that are letters the language lacks; of what ``cleaned`` returns."""
        counts = np.zeros((len(sizes), len(self.languages)), np.int64)
        unseen = np.zeros_like(counts)
        stretches = -(-sizes // _STEP)
        owner = np.repeat(np.arange(len(sizes)), stretches)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        size = np.minimum(sizes[owner] - nth * _STEP, _STEP)
        begin = nth * _STEP + (np.cumsum(sizes) - sizes)[owner]
        carry = [0] * len(self.tables)
        for lo in range(0, len(owner), _LANES):
            hi = min(lo + _LANES, len(owner))
            lanes = lo + np.argsort(-size[lo:hi], kind="stable")
            place = np.empty(hi - lo, np.int64)
            place[lanes - lo] = np.arange(hi - lo)
            after = np.where(nth[lanes] == 0, -1, place[lanes - lo - 1])
            after[(nth[lanes] > 0) & (lanes == lo)] = -2
            final = nth[lanes] == stretches[owner[lanes]] - 1
            steps = np.arange(int(size[lanes[0]]))[:, None]
            inside = steps < size[lanes]
            symbols = np.where(inside, self.codes[codes[np.where(inside, begin[lanes] + steps, 0)]], -1)
            live = inside.sum(axis=1).tolist()
            for k, table in enumerate(self.tables):
                own = self.own[k][symbols]
                ended, state = table.run(own, live, after, carry[k])
                carry[k] = int(state[place[-1]])
                np.add.at(counts[:, k], owner[lanes], ended + (final & (state > 0)))
                np.add.at(unseen[:, k], owner[lanes], (own == table.width - 2).sum(axis=0))
        return counts, unseen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 - bits of the best language / bits of the second; und and 0 without letters."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None], usual: tuple[float, float] | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """``predict``, each text's bits per letter in its language, and whether those fit it.

        ``usual`` is what ``usual_bits`` finds. More than ``_FAR`` deviations above the mean do not fit, nor does a text
        without letters. Texts shorter than a piece deviate more, by the root of their length. What letters drawn evenly from the
        language's alphabet would cost always fits, and so does everything without ``usual``.
        """
        names, scores, rates, fits, lo = [], [], [], [], 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= _STEP * _LANES):
                held += len(texts[hi] or "")
                hi += 1
            codes, sizes = cleaned(texts[lo:hi])
            counts, unseen = self.parsed(codes, sizes)
            cost = (counts - unseen) * self.bits + unseen * _LETTER_BITS
            for row, n in zip(cost, sizes, strict=True):
                if not n or not len(row):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    rates.append(0.0)
                    fits.append(usual is None)
                    continue
                best = int(np.argmin(row))
                rest = np.delete(row, best)
                names.append(self.languages[best])
                scores.append(1.0 if not len(rest) else float(1 - row[best] / rest.min()))
                rates.append(float(row[best] / n))
                fits.append(usual is None or rates[-1] <= max(np.log2(max(2, self.tables[best].width - 2)), usual[0] + _FAR * usual[1] * max(1.0, (_PIECE / n) ** 0.5)))
            lo = hi
        return names, np.array(scores, float), np.array(rates, float), np.array(fits, bool)


def usual_bits(samples: tuple[tuple[str, str], ...]) -> tuple[float, float] | None:
    """Mean and deviation of the bits per letter of pieces of each language's second half, parsed against the first halves.

    The deviation is drawn towards one bit, which counts for ``_PRIOR_PIECES`` pieces, so that little labelled text leaves a wide limit.
    None without any piece, as without any language.
    """
    halves = [(lang, text[: len(text) // 2], text[len(text) // 2 :]) for lang, text in samples]
    pieces = [rest[i : i + _PIECE] for _, _, rest in halves for i in range(0, len(rest) - _PIECE + 1, _PIECE)]
    if not pieces:
        return None
    rates = Parser(tuple((lang, learned) for lang, learned, _ in halves)).judge(pieces)[2]
    return float(rates.mean()), float(np.sqrt((((rates - rates.mean()) ** 2).sum() + _PRIOR_PIECES) / (len(rates) + _PRIOR_PIECES)))


def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return held(("parser", samples), lambda: Parser(samples))


def labelled_samples(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", letters_in_all: int = LETTERS_IN_ALL, stretch: int = STRETCH
) -> tuple[tuple[str, str], ...]:
    """(language, labelled text) by language, from documents that are not held out.

    A text gives one stretch of at most ``stretch`` characters from its
    middle. Corpus counts of the different stretches of a language give the rate at which they are drawn by
    hash, so neither copies nor equal or null ids count more than once. Languages get equal shares of
    ``letters_in_all`` letters or ``LEAST_LETTERS``, the bound on what reaches the driver and each worker; each gets
    one stretch at least.
    """
    can_teach = F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & ~held_out(F.col(id_col))
    long = F.length(text_col)
    part = F.substring(F.col(text_col), F.greatest(F.lit(1), F.floor((long - stretch) / 2).cast("int")), F.lit(stretch))
    rows = docs.where(can_teach).select(F.col(lang_col).alias("lang"), part.alias("part"))
    drawn = F.pmod(F.xxhash64("part", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.select("lang", F.length("part").alias("size"), drawn.alias("drawn"), "part")
    different = rows.groupBy("lang", "drawn").agg(F.first("size").alias("size"))
    totals = stage(different.groupBy("lang").agg(F.sum("size").alias("held"), F.min("drawn").alias("first")), "languages")
    share = max(LEAST_LETTERS, letters_in_all // max(1, totals.count()))
    rate = totals.select(F.col("lang").alias("_lang"), F.greatest(F.lit(1.5 * share) / F.col("held"), F.col("first")).alias("rate"))
    found = rows.join(rate, F.col("lang") == F.col("_lang")).where("drawn <= rate")
    texts: dict[str, list[str]] = {}
    for lang, part in sorted((r["lang"], r["part"]) for r in found.groupBy("lang", "drawn").agg(F.min("part").alias("part")).collect()):
        texts.setdefault(lang, []).append(letters(part))
    samples = ((lang, " ".join(parts)[:share].strip()) for lang, parts in sorted(texts.items()))
    return tuple((lang, text) for lang, text in samples if text)


def with_language(
    docs: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", fits_out: str | None = None, usual: tuple[float, float] | None = None
) -> DataFrame:
    """``docs`` with the language of every whole text and its score.

    Null, empty and letterless texts are ``und`` with score 0, and so is every text if
    there are no samples. Equal bits go to the first language in code point
    order. Only the text is looked at; columns that have the names of the new ones are replaced.
    ``fits_out`` names a column that tells whether the text fits its language, as ``Parser.judge`` has it.
    """
    empty = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("fits", pa.bool_())])

    @F.arrow_udf("lang string, score double, fits boolean")
    def predicted(text: pa.Array) -> pa.Array:
        names, scores, _, fits = _parser(samples).judge(text.to_pylist(), usual)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())], fields=list(empty))

    new = {lang_out: "lang", score_out: "score"} | ({fits_out: "fits"} if fits_out else {})
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    (found,) = fresh(docs.columns, "_language")
    met = docs.select(*kept, predicted(F.col(f"`{text_col}`").cast("string")).alias(found))
    return met.select(*kept, *[F.col(f"{found}.{c}").alias(out) for out, c in new.items()])
