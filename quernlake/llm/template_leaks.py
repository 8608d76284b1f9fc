"""Benchmark decontamination by template canonicalisation.

Tokens are words without outer punctuation, in lower case. A token with a digit becomes <number>, a unit after a number
<unit>, a capitalised word inside a sentence <name>; the benchmark's windows are also kept with names as plain words,
for texts that lost their case. A capitalised word at the start of a sentence or line may be either, so on both sides
windows are looked up in each reading of up to OPENINGS such words (with more: all plain or all names). Windows of WINDOW such tokens of the benchmark are a hash table
that the windows of all whole documents are joined with. Matches of one item along one alignment are taken together;
its slots must be consistent: equal values of the benchmark's slots stand for equal values in the document. So a question that was given other numbers and names is found, and a text that only
has the same shape is not. A document leaks an item if at least LEAST windows (or all, if the item has fewer) agree.

The benchmark is cut into blocks of at most BLOCK_TOKENS tokens, files in the shared folder that the driver writes one at a
time. A task canonicalises each of its documents once and looks its windows up in one block after the other, so the driver and
a worker hold one block whatever the size of the benchmark, the plan has one step, and there is no shuffle.

Cases: null counts as empty. Items under WINDOW tokens are one window of their own length; windows with fewer than
LITERALS ordinary words are left out, as anything would match them, but an item of only such windows is matched with its
numbers and names as they are. Items under SHORTEST tokens leak only in a text that has these tokens and no others, items
without a token nowhere; items without an id can't be reported and are not looked for. Equal items are all reported. Different
values of an item's slots may have one value in a document. Documents of any length are read whole, and neither merged nor
dropped here. An empty benchmark leaks nowhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.rows import id_and_text, text_of
from quernlake.llm.shared_files import opened, write_once
from quernlake.llm.words import STEP_BYTES, chunks, held, mix, steps
from quernlake.shared import new_path

WINDOW = 8
LEAST = 6
SHORTEST = 4
LITERALS = 4
BLOCK_TOKENS = 500_000
#: Bits by which windows are sieved before they are searched in the table.
SIEVE_BITS = 20
#: Capitalised starts of sentences in a window of which every reading is looked up.
OPENINGS = 4
UNITS = frozenset("% percent mm cm m km mile miles foot feet inch inches yard yards mg g kg ton tons tonne tonnes gram grams kilogram kilograms ounce ounces pound pounds lb lbs ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents rupee rupees mph kmh kph degree degrees celsius fahrenheit volt volts watt watts joule joules newton newtons".split())
_CORE = r"(?s)^[^\p{L}\p{N}%]*(?P<core>.*?)[^\p{L}\p{N}%]*$"
_NUMBER, _UNIT, _NAME = (xxhash.xxh3_64_intdigest(x) for x in ("<number>", "<unit>", "<name>"))
_FACTORS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
_WORD, _DIGITS, _MEASURE, _CAPITAL, _NOTHING = range(5)


def _tokens(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each piece's plain token, its kind, and whether a sentence ends with it."""
    flags = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    plain = pc.extract_regex(pieces, _CORE).field(0)
    low = pc.utf8_lower(plain)
    value = np.fromiter(map(xxhash.xxh3_64_intdigest, low.to_pylist()), np.uint64, len(low))
    nothing = flags(pc.equal(pc.binary_length(plain), 0))
    capital = flags(pc.utf8_is_upper(pc.utf8_slice_codeunits(plain, 0, 1))) & ~(flags(pc.utf8_is_upper(plain)) & flags(pc.greater(pc.utf8_length(plain), 1)))
    kind = np.select([nothing, flags(pc.match_substring_regex(plain, r"\p{Nd}")), flags(pc.is_in(low, pa.array(sorted(UNITS)))), capital], [_NOTHING, _DIGITS, _MEASURE, _CAPITAL], _WORD)
    ends = np.where(nothing, flags(pc.match_substring_regex(pieces, r"[.!?]$")), flags(pc.match_substring_regex(pieces, r"[.!?:][\"'”’)\]]*$")))
    return np.where(nothing, np.uint64(0), value), kind, ends


@dataclass
class Canonical:
    """Tokens of some texts: what each stands for in a window, also with names as they are, its value, whether it is a slot, whether it is a capitalised start of a sentence, and each text's first token."""

    stands: np.ndarray
    named: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    opens: np.ndarray
    offsets: np.ndarray


def canonical(texts: pa.Array) -> Canonical:
    distinct, which, offsets = chunks(pc.replace_substring(texts, "\n", " . "))  # a line starts a sentence
    value, kind, ends = (x[which] for x in _tokens(distinct))
    starts = np.zeros(len(which), bool)
    starts[1:] = ends[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = True
    full = kind != _NOTHING
    for at in np.flatnonzero(~full[:-1] & ~ends[:-1]) if len(full) else ():  # a bare mark hands the start of a sentence on
        starts[at + 1] |= starts[at]
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    value, kind, starts = value[full], kind[full], starts[full]
    number = kind == _DIGITS
    unit = np.zeros(len(kind), bool)
    unit[1:] = (kind[1:] == _MEASURE) & number[:-1]
    name = (kind == _CAPITAL) & ~starts
    named = np.select([number, unit], [np.uint64(_NUMBER), np.uint64(_UNIT)], value)
    return Canonical(np.where(name, np.uint64(_NAME), named), named, value, number | unit | name, (kind == _CAPITAL) & starts, offsets)


def _hashes(stands: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """A sum over the tokens of a window, each with the factor of its place, so another reading of a token is one addition."""
    total = np.full(len(at), np.uint64(size))
    for k in range(size):
        total += stands[at + k] * _FACTORS[k]
    return total


def _windows(c: Canonical, size: int, stands: np.ndarray, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first token and hash of each window of `size` tokens inside a text with enough ordinary words."""
    n = np.diff(c.offsets)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(c.offsets[1:][owner] - np.arange(len(owner)) >= size)
    words = np.concatenate([[0], np.cumsum(~c.slot)])
    enough = words[at + size] - words[at] >= min(literals, size)
    at = at[enough]
    return owner[at], at, _hashes(stands, size, at)


def _readings(c: Canonical, size: int, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in `at` and hash of the further readings of windows with the hashes `base`, in which capitalised starts of sentences are names, with enough ordinary words."""
    before = np.concatenate([[0], np.cumsum(c.opens)])
    words = np.concatenate([[0], np.cumsum(~c.slot)])
    opening = np.flatnonzero(c.opens)
    many, plain = before[at + size] - before[at], words[at + size] - words[at]
    index, hashed = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k in range(1, int(many.max(initial=0)) + 1):
        these = np.flatnonzero((many == k) & (plain > min(LITERALS, size)))
        places = [opening[before[at[these]] + j] for j in range(k)]
        change = [(np.uint64(_NAME) - c.stands[x]) * _FACTORS[x - at[these]] for x in places]
        for mask in range(1, 1 << k) if k <= OPENINGS else ((1 << k) - 1,):
            use = plain[these] - mask.bit_count() >= min(LITERALS, size)
            index.append(these[use])
            hashed.append((base[these] + sum(x for j, x in enumerate(change) if mask >> j & 1))[use])
    return np.concatenate(index), np.concatenate(hashed)


@dataclass
class Block:
    """The windows of some items, and for items without one those of their plain tokens, by size: hashes ascending, with the item, its place and the tokens themselves."""

    ids: np.ndarray
    tokens: Canonical
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    exact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # of sizes under SHORTEST: of whole texts
    needed: np.ndarray


def block_of(items: list[tuple[int, str]]) -> Block:
    c = canonical(pa.array([t for _, t in items], pa.string()))
    n = np.diff(c.offsets)
    windows, needed = {}, np.zeros(len(items), np.int64)
    for size in sorted({WINDOW, *(int(k) for k in n if SHORTEST <= k < WINDOW)}):
        owner, at, hashed = _windows(c, size, c.stands)
        named = _windows(c, size, c.named)[2]
        own = n[owner] >= WINDOW if size == WINDOW else n[owner] == size
        owner, at, hashed, named = owner[own], at[own], hashed[own], named[own]
        needed += np.bincount(owner, minlength=len(items))
        more = named != hashed  # a text without capitals has names as plain words
        owner, at, hashed = np.concatenate([owner, owner[more]]), np.concatenate([at, at[more]]), np.concatenate([hashed, named[more]])
        index, read = _readings(c, size, at[: int(own.sum())], hashed[: int(own.sum())])
        owner, at, hashed = np.concatenate([owner, owner[index]]), np.concatenate([at, at[index]]), np.concatenate([hashed, read])
        order = np.argsort(hashed, kind="stable")
        windows[size] = (hashed[order], owner[order], at[order])
    poor, exact = (needed == 0) & (n > 0), {}
    for size in sorted({int(min(k, WINDOW)) for k in n[poor]}):
        owner, at, hashed = _windows(c, size, c.value, 0)
        own = poor[owner] & (np.minimum(n[owner], WINDOW) == size)
        owner, at, hashed = owner[own], at[own], hashed[own]
        needed += np.bincount(owner, minlength=len(items))
        order = np.argsort(hashed, kind="stable")
        exact[size] = (hashed[order], owner[order], at[order])
    return Block(np.array([i for i, _ in items], np.int64), c, windows, exact, np.minimum(needed, LEAST))


def leaks(c: Canonical, block: Block) -> list[tuple[int, int]]:
    """(text, item) of the texts that leak an item of the block, ascending, each pair once."""
    docs, items, places, shifts, sizes = [], [], [], [], []
    for size, (hashed, owner, at), plain in [*((k, x, False) for k, x in block.windows.items()), *((k, x, True) for k, x in block.exact.items())]:
        if not len(hashed):
            continue
        if plain:
            text, place, h = _windows(c, size, c.value, 0)
            if size < SHORTEST:
                whole = (np.diff(c.offsets) == size)[text]
                text, place, h = text[whole], place[whole], h[whole]
        else:
            text, place, h = _windows(c, size, c.stands)
            index, read = _readings(c, size, place, h)
            text, place, h = np.concatenate([text, text[index]]), np.concatenate([place, place[index]]), np.concatenate([h, read])
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[hashed >> np.uint64(64 - SIEVE_BITS)] = True
        may = sieve[h >> np.uint64(64 - SIEVE_BITS)]
        text, place, h = text[may], place[may], h[may]
        low, high = np.searchsorted(hashed, h, "left"), np.searchsorted(hashed, h, "right")
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        index = np.repeat(low[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        docs.append(np.repeat(text[hit], count))
        places.append(np.repeat(place[hit], count))
        items.append(owner[index])
        shifts.append(np.repeat(place[hit], count) - at[index])
        sizes.append(np.full(len(index), size))
    if not docs or not sum(map(len, docs)):
        return []
    docs, items, places, shifts, sizes = map(np.concatenate, (docs, items, places, shifts, sizes))
    order = np.lexsort((places, shifts, items, docs))
    docs, items, places, shifts, sizes = docs[order], items[order], places[order], shifts[order], sizes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]) | (shifts[1:] != shifts[:-1])
    starts = np.flatnonzero(new)
    found = set()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(docs)], strict=True):
        pair = (int(docs[a]), int(items[a]))
        if b - a >= block.needed[items[a]] and len(np.unique(places[a:b])) >= block.needed[items[a]] and pair not in found and _consistent(c, block.tokens, places[a:b], int(sizes[a]), int(shifts[a])):
            found.add(pair)
    return sorted(found)


def _consistent(c: Canonical, bench: Canonical, places: np.ndarray, size: int, shift: int) -> bool:
    """Whether equal slots of the item are equal in the aligned windows."""
    covered = np.unique((places[:, None] + np.arange(size)).ravel())
    covered = covered[c.slot[covered] | (c.value[covered] != bench.value[covered - shift])]
    there: dict[int, int] = {}
    return all(there.setdefault(x, y) == y for x, y in zip(bench.value[covered - shift].tolist(), c.value[covered].tolist(), strict=True))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The items in blocks; a caller that lets each go has one block at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).where("id IS NOT NULL").toLocalIterator():
        n = len(row["text"].split())
        if held and size + n > block_tokens:
            yield block_of(held)
            held, size = [], 0
        held.append((row["id"], row["text"]))
        size += n
    if held:
        yield block_of(held)


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """doc_id, items (ids that the text leaks, ascending), contaminated and kept; one row for each row of docs."""
    found = with_leaks(id_and_text(docs, id_col, text_col), benchmark, **names)
    return found.select("row.doc_id", "items", (F.size("items") > 0).alias("contaminated"), (F.size("items") == 0).alias("kept"))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """row (all columns of docs as a struct, whatever their names) and items, for each row of docs."""
    folder, files = new_path(docs.sparkSession, "leak-blocks"), []
    for k, block in enumerate(blocks(benchmark, **names)):
        files.append(f"{folder}/block-{k:06d}")
        write_once(files[-1], lambda out, block=block: out.write(pickle.dumps(block)))
    rows = docs.select(F.struct("*").alias("row"), text_of(text_col).alias("text"), F.array().cast("array<long>").alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, step_bytes=STEP_BYTES * max(1, min(8, len(files)))):
            at = batch.schema.get_field_index("items")
            found: list[set[int]] = [set() for _ in range(batch.num_rows)]
            c = canonical(batch.column("text"))
            for file in files:
                block = held(file, lambda file=file: _read_block(file))
                for text, item in leaks(c, block):
                    found[text].add(int(block.ids[item]))
            yield batch.set_column(at, "items", pa.array([sorted(x) for x in found], pa.list_(pa.int64())))

    return rows.mapInArrow(run, rows.schema).select("row", "items")


def _read_block(file: str) -> Block:
    store, path = opened(file)
    with store.open_input_stream(path) as stream:
        return pickle.loads(stream.read())
