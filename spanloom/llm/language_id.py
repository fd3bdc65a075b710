"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is cut into phrases, each
the longest string from where the last ended that the language's sample holds, or else one letter; the entropy is the
number of phrases times log2(sample length) by the text's length, and the language that needs fewest normalised phrases
wins. Texts are lower-cased, and runs of anything but letters become one space. Letters are code points, of any script.

All automata share one table of transitions, whose size follows the samples (some 400 bytes a character of ALL_CHARS in
all), not the languages' letters: the most frequent letters have columns, all others a hash table. Texts are parsed in blocks side by side, a letter of all blocks in one vector step;
blocks are then joined so that phrases are those of one parse of the whole text.

Cases: a null text, an empty one or one without a letter is `und` with score 0. A letter that a sample lacks is a phrase
of its own there; of a text of such letters only, the language with the shortest sample is the nearest. Ties go to the
smaller language name. Without labelled rows every text is `und`, and `drop_unidentified` drops texts without a letter
only. Null ids are never held out. Rows with null labels are predicted, not learned from. Repeated rows are treated
alike. Extra columns are ignored by `identify`; `drop_unidentified` carries them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import held, sliced, trim

#: The sample of a language: about so many documents, so many characters of all at most.
SAMPLE_DOCS, SAMPLE_CHARS = 100, 40_000
#: Characters of all languages' samples together at most; beyond 15 languages, a language's sample gets shorter.
ALL_CHARS = 600_000
#: Characters of a block, and characters parsed side by side, about.
BLOCK, SIDE_BY_SIDE = 4096, 1 << 21
SHARPNESS = 8.0
#: Columns of a state's row, the first for letters that have none. Bits of a letter's number.
SPACE, DENSE, LETTER_BITS = 32, 64, 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: So few parses go on one by one; so many rows are held at a time.
FEW, ROWS = 24, 1000


def held_out(id_: Column, of: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % of == remainder, F.lit(False))


def samples(df: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column) -> dict[str, str]:
    """Labelled text by language: a hash sample of documents, the same in each run.

    Documents are taken whole, in the order of their hash, while they fit. Only a language without any that fits has a
    part of one. Equal rows have one hash and count once.
    """
    usable = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), 1)
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).agg(F.approx_count_distinct(order)).collect()}  # a row per language
    if not counts:
        return {}
    room = min(SAMPLE_CHARS, ALL_CHARS // len(counts))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE_DOCS / max(1, n)))]), F.col(lang_col))
    # A language of few documents is taken whole; else about SAMPLE_DOCS are.
    some = usable.where(order <= share * float(1 << 63)).select(F.col(lang_col).alias("lang"), order.alias("order"), (F.length(text_col) > room).alias("long"), F.substring(text_col, 1, room).alias("text"))
    rows = some.groupBy("lang", "order", "long").agg(F.min("text").alias("text")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["long"], r["order"])):
        held_ = out.get(r["lang"])
        if held_ is None or not r["long"] and len(held_) + len(r["text"]) < room:
            out[r["lang"]] = r["text"] if held_ is None else f"{held_} {r['text']}"
    return out


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, with a space for each run of anything but letters; and their number by text."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "uint32")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    space = ~letters()[codes]
    keep = ~space
    keep[1:] |= ~space[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    return np.where(space, SPACE, codes)[keep], np.bincount(owner[keep], minlength=len(texts))


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton's states; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
        last = new
    return moves


class Moves:
    """Transitions of all automata: a row of DENSE numbers a state for the most frequent letters, and an open-addressed
    table for all others, so that memory follows the samples and not the number of letters.

    States are numbered in steps of DENSE; state 0 has no moves. Letters are numbered by falling frequency from 1; 0 is
    any that no sample has.
    """

    def __init__(self, states: int, state: np.ndarray, letter: np.ndarray, to: np.ndarray) -> None:
        to = to * DENSE
        self.dense = np.zeros(states * DENSE, "int32")
        often = letter < DENSE
        self.dense[state[often] * DENSE + letter[often]] = to[often]
        self.keys, self.to = (state[~often] << LETTER_BITS) + letter[~often], to[~often]
        bits = max(4, (3 * len(self.keys)).bit_length())
        self.slots, self.last, self.down = np.full(1 << bits, -1), (1 << bits) - 1, np.uint64(64 - bits)
        slot, own = self._slots(self.keys), np.arange(len(self.keys))
        while len(own):
            empty = self.slots[slot] < 0
            self.slots[slot[empty]] = own[empty]
            left = self.slots[slot] != own  # someone else's
            own, slot = own[left], slot[left] + 1 & self.last

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype("uint64") * _SPREAD >> self.down).view("int64")

    def rare(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The state after each letter that has no column; 0 where there is none."""
        key, out, left = (state.astype("int64") // DENSE << LETTER_BITS) + c, np.zeros(len(state), "int32"), np.arange(len(state))
        slot = self._slots(key)
        while len(left):
            at = self.slots[slot]
            there = at >= 0
            left, key, slot, at = left[there], key[there], slot[there], at[there]
            hit = self.keys[at] == key
            out[left[hit]] = self.to[at[hit]]
            left, key, slot = left[~hit], key[~hit], slot[~hit] + 1 & self.last
        return out

    def after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The state after each letter; 0 where there is none."""
        out = self.dense.take(state + np.where(c < DENSE, c, 0))
        rare = np.flatnonzero(c >= DENSE)
        if len(rare):
            out[rare] = self.rare(state[rare], c[rare])
        return out


class Parser:
    """Counts phrases against every language's automaton at once."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        coded = [codes_of([f" {texts[lang]} "])[0] for lang in self.langs]
        shares: dict[int, float] = {}
        for own in coded:
            for c, n in zip(*(x.tolist() for x in np.unique(own, return_counts=True))):
                shares[c] = shares.get(c, 0.0) + n / len(own)
        known = sorted(shares, key=lambda c: (-shares[c], c))
        self.number = np.zeros(0x110000, "int32")
        self.number[known] = np.arange(1, len(known) + 1)
        total = 1
        self.first = np.zeros((len(coded), len(known) + 1), "int32")  # the state after a phrase's first letter
        parts = [np.zeros((3, 0), "int64")]  # state, letter, next state; one language's automaton is held at a time
        for k, own in enumerate(coded):
            made = automaton(self.number[own].tolist())
            for c, to in made[0].items():
                self.first[k, c] = (to + total) * DENSE
            sizes = np.fromiter(map(len, made), "int64", len(made))
            letter, to = (np.fromiter((x for out in made for x in of(out)), "int64", int(sizes.sum())) for of in (dict.keys, dict.values))
            parts.append(np.stack([np.repeat(np.arange(len(made)), sizes) + total, letter, to + total]))
            total += len(made)
            del made
        self.moves = Moves(total, *np.concatenate(parts, axis=1))
        self.bits = np.array([math.log2(max(2, len(own))) for own in coded])

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language, and normalised length, of each text; rows (text, language)."""
        counts, lengths = np.zeros((len(texts), len(self.langs)), "int64"), np.zeros(len(texts), "int64")
        first, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= SIDE_BY_SIDE or k == len(texts) - 1:
                counts[first : k + 1], lengths[first : k + 1] = self._side_by_side([t or "" for t in texts[first : k + 1]])
                first, size = k + 1, 0
        return counts, lengths

    def _side_by_side(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut to blocks that are parsed side by side, each from its start. A block's parse is then taken up
        where the one before leaves off; parses meet as a rule after a few phrases, and from there on they agree."""
        codes, lengths = codes_of(texts)
        codes = self.number[codes]
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        order = np.argsort(-np.minimum(BLOCK, lengths[owner] - nth * BLOCK), kind="stable")
        owner, nth = owner[order], nth[order]
        upto = np.cumsum(lengths)[owner]  # where the block's text ends
        start = upto - lengths[owner] + nth * BLOCK
        end = np.minimum(start + BLOCK, upto)
        height, wide, many = int((end - start).max(initial=0)), len(owner), len(self.langs)
        made = np.zeros((height, many, wide), bool)  # whether a phrase starts at a place of a block
        state = np.zeros((many, wide), "int32")
        active = np.searchsorted(start - end, -np.arange(height), "left")
        seldom = bool((codes >= DENSE).any())
        for t in range(height):
            n = active[t]
            c = codes[start[:n] + t]
            to = self.moves.dense.take(state[:, :n] + (np.where(c < DENSE, c, 0) if seldom else c))
            if seldom and len(lane := np.flatnonzero(c >= DENSE)):
                to[:, lane] = self.moves.rare(state[:, lane].ravel(), np.tile(c[lane], many)).reshape(many, -1)
            lost = np.equal(to, 0, out=made[t, :, :n])
            state[:, :n] = np.where(lost, self.first[:, c], to)
        # Each block's last phrase goes on into the next one.
        later = np.flatnonzero(end < upto)
        language, lane = (x.ravel() for x in np.meshgrid(np.arange(many), later, indexing="ij"))
        leaves = np.broadcast_to(end, (many, wide)).copy()
        self._go_on(codes, language, lane, end[lane], state[language, lane], start, end, upto, made, leaves)
        entered = np.broadcast_to(start, (many, wide)).copy()
        place = {(o, k): x for x, (o, k) in enumerate(zip(owner.tolist(), nth.tolist()))} if len(later) else {}
        follower = np.array([place[o, k + 1] for o, k in zip(owner[later].tolist(), nth[later].tolist())], "int64")
        while True:
            language, which = np.nonzero(leaves[:, later] != entered[:, follower])
            if not len(which):
                break
            lane, at = follower[which], leaves[language, later[which]]
            entered[language, lane] = at
            for k in range(int((np.minimum(at, end[lane]) - start[lane]).max())):  # what starts before is not a phrase
                before = start[lane] + k < at
                made[np.minimum(k, height - 1), language[before], lane[before]] &= start[lane[before]] + k >= end[lane[before]]
            past = at >= end[lane]  # a phrase that holds the whole block
            leaves[language[past], lane[past]] = at[past]
            own = ~past
            self._go_on(codes, language[own], lane[own], at[own], np.zeros(int(own.sum()), "int32"), start, end, upto, made, leaves)
        counts = np.zeros((len(texts), many), "int64")
        np.add.at(counts, owner, made.sum(axis=0).T)
        return counts, lengths

    def _go_on(self, codes, language, lane, at, state, start, end, upto, made, leaves) -> None:
        """Parses on from places `at`, until a phrase starts where the block's former parse has one or after the block's
        end; corrects `made` and `leaves` on the way."""
        while len(at):
            if len(at) <= FEW:
                for x in zip(language.tolist(), lane.tolist(), at.tolist(), state.tolist()):
                    self._go_on_alone(codes, *x, start, end, upto, made, leaves)
                break
            over = at >= upto[lane]
            leaves[language[over], lane[over]] = at[over]
            if over.any():
                language, lane, at, state = (x[~over] for x in (language, lane, at, state))
                if not len(at):
                    break
            c = codes[at]
            to = self.moves.after(state, c)
            lost, inside = to == 0, at < end[lane]
            k = np.minimum(at - start[lane], made.shape[0] - 1)
            met = lost & inside & made[k, language, lane]
            out = lost & ~inside
            leaves[language[out], lane[out]] = at[out]
            made[k[inside], language[inside], lane[inside]] = lost[inside]
            again = np.flatnonzero(lost)
            to[again] = self.first[language[again], c[again]]
            stay = ~(met | out)
            language, lane, at, state = language[stay], lane[stay], at[stay] + 1, to[stay]

    def _go_on_alone(self, codes, language: int, lane: int, at: int, state: int, start, end, upto, made, leaves) -> None:
        """`_go_on` of one block, a letter at a time."""
        dense, first, own = self.moves.dense, self.first[language], made[:, language, lane]
        begin, stop, last = start.item(lane), end.item(lane), upto.item(lane)
        while at < last:
            c = codes.item(at)
            to = dense.item(state + c) if c < DENSE else self.moves.rare(np.array([state]), np.array([c])).item(0)
            if at < stop:
                if not to and own.item(at - begin):
                    return
                own[at - begin] = not to
            elif not to:
                break
            state = to or first.item(c)
            at += 1
        leaves[language, lane] = at

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        counts, lengths = self.phrases(texts)
        bits = counts * self.bits / np.maximum(lengths, 1)[:, None]
        best = bits.argmin(axis=1)
        near = np.exp2(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
        return [(self.langs[b], float(1 / s)) if t and any(map(str.isalpha, t)) else ("und", 0.0) for t, b, s in zip(texts, best, near)]


def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    made = Parser(dict(texts))
    trim()
    return made


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None) -> DataFrame:
    """One row per row of df: id, held_out, lang_pred, score. Learns from rows where `learn` holds (default: those not held out)."""
    learned = tuple(sorted(samples(df, id_col, text_col, lang_col, ~held_out(F.col(id_col)) if learn is None else learn).items()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(_parser, learned)
        for batch in sliced(batches, ROWS):
            found = parser.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def drop_unidentified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.0) -> DataFrame:
    """df's rows whose language is identified with a score above least_score; all columns stay.

    With the default, these are the rows whose text has a letter: a language that was not learned is taken for the
    nearest. Where nothing was learned no language can be told, and rows whose text has a letter stay too.
    """
    learned = tuple(sorted(samples(df, id_col, text_col, lang_col, ~held_out(F.col(id_col))).items()))

    at = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(_parser, learned)
        for batch in sliced(batches, ROWS):
            texts = batch.column(at).to_pylist()
            if not learned:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
                continue
            found = parser.predict(texts)
            yield batch.filter(pa.array([lang != "und" and score > least_score for lang, score in found], pa.bool_()))

    plain = df.toDF(*[f"c{n}" for n in range(len(df.columns))])  # no names that a UDF cannot take
    return plain.mapInArrow(keep, plain.schema).toDF(*df.columns)
