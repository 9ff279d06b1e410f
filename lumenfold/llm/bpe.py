"""BPE encoding and decoding with forced boundaries.

A merge can only build tokens of the vocabulary. So where two neighbouring base symbols (a byte, or a byte that
ends a word) stand side by side in no token, no token spans that place: it is a certain cut. The fragments between
such cuts are encoded independently and concatenated, which gives exactly the ids of the whole word.

Texts stream through Arrow batches in scan order, so there is no shuffle. ``encode`` takes texts one at a time and keeps
the ids of words in a cache of bounded size. ``encode_many`` takes a slice of a batch: Arrow lists its distinct words, the
fragments of all of them are merged side by side, and each text gathers its ids.

Defined results: null and empty texts have no ids and decode to the empty string; repeated rows give repeated
results; other columns pass through unless they have the name of an output, which then replaces them.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import table

#: Entries of the younger of two generations of a cache.
CACHE_ENTRIES = 250_000
#: Output rows are handed over once they hold so many tokens.
BATCH_TOKENS = 1_000_000
#: Texts are encoded together up to so many bytes.
SLICE_BYTES = 16_000_000
#: Fragments of more base symbols are merged one at a time.
WIDEST = 40
END = "</w>"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Beyond these characters the tokenizer file's own normaliser and splitter decide (rare scripts, odd white space,
#: combining marks, letters whose lower case depends on the place).
UNUSUAL = re.compile("[^\t\n\r -~¡-įı-ſА-я‐-‧]")
NEVER = 1 << 62
#: The same where ranks are held in 32 bits.
LAST = (1 << 31) - 1
#: Words that are merged side by side.
BLOCK = 20_000
#: By usual character: 0 a letter, 1 neither letter nor numeral, 2 a numeral, 3 white space.
KINDS = np.array([next(k for k, x in ((3, r"\s"), (0, r"\p{L}"), (2, r"\p{N}"), (1, r"(?s:.)")) if regex.match(x, chr(i))) for i in range(0x2028)], dtype=np.int8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Cache:
    """Two generations of a dict: bounded, and what is in use stays."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.young, self.old = entries, {}, {}

    def get(self, key: str) -> str | None:
        if (found := self.young.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: str) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value


class ForcedBoundaryBpe:
    """Ids are held as characters of a string: the ids of a text are the concatenation of those of its chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        if len(self.tokens) > 0xD800:
            raise ValueError("ids beyond 55,295 don't fit this encoder")
        self.added = {k: chr(i) for k, i in added.items()}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")")
        self.symbols = byte_symbols()
        self.base = [vocab[x] for x in self.symbols]
        self.last = [vocab[x + END] for x in self.symbols]
        self.byte = {x: b for b, x in enumerate(self.symbols)}
        self.inside = dict.fromkeys((vocab[a] << 16 | vocab[b] for token in vocab for a, b in self._pairs(token)), NEVER)
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << 16 | vocab[b], rank << 16 | vocab[a + b])
        # one look tells of a base pair whether some token spans it (else it is a cut) and whether it merges
        self.inside.update((k, self.ranks[k]) for k in self.inside.keys() & self.ranks.keys())
        # the same as arrays: base symbols (a byte, or 256 more where it ends a word), what is known of their pairs (-1: a cut), merges by pair
        ordered = sorted(self.ranks.items())
        self.pairs = np.array([pair for pair, _ in ordered], dtype=np.uint32)
        self.rank_of = np.array([found >> 16 for _, found in ordered], dtype=np.int32)
        self.made = np.zeros(len(spec["model"]["merges"]), dtype=np.int32)
        self.made[self.rank_of] = [found & 0xFFFF for _, found in ordered]
        every = self.base + self.last
        self.numbered = np.array(every, dtype=np.int32)
        self.first = np.array([[min(self.inside.get(a << 16 | b, -1) >> 16, LAST) for b in every] for a in self.base], dtype=np.int32)
        self.library = Tokenizer.from_file(path)
        self.words, self.others = Cache(), Cache(20_000)  # of letters only, and the rest
        self.marks = {x: self.encode_word(x) for x in ".,;:!?"}

    def _pairs(self, token: str):
        """Neighbouring base symbols in a token, with its end read as the end of a word and as plain characters."""
        for parts in ([*token[: -len(END) - 1], token[-len(END) - 1 :]], [*token]) if token.endswith(END) and len(token) > len(END) else ([*token],):
            yield from zip(parts, parts[1:], strict=False)

    def merge(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The merges of one fragment with the ranks of its pairs: lowest rank first, then leftmost."""
        if len(ids) > WIDEST:
            return self._merge_long(ids)
        get = self.ranks.get
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            new = ids[i] = best & 0xFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 16 | new, NEVER)
            if i < len(ranks):
                ranks[i] = get(new << 16 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same through a heap and a linked list, for words of thousands of letters."""
        n, get = len(ids), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rank := get(a << 16 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank & 0xFFFF, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := get(ids[i] << 16 | ids[j])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 16 | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def fragments_of(self, ids: list[int]) -> list[tuple[list[int], list[int]]]:
        """The base symbols of a word and the ranks of their pairs, cut where no token spans."""
        get = self.inside.get
        ranks = [get(a << 16 | b) for a, b in zip(ids, ids[1:], strict=False)]
        if None not in ranks:
            return [(ids, ranks)]
        cuts = [0, *(i + 1 for i, rank in enumerate(ranks) if rank is None), len(ids)]
        return [(ids[a:b], ranks[a : b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_word(self, word: str) -> str:
        """A word of the splitter; its ids stay in a cache."""
        cache = self.words if word.isalpha() else self.others
        if (found := cache.get(word)) is None:
            data = word.encode()
            base = self.base
            symbols = [base[b] for b in data]
            symbols[-1] = self.last[data[-1]]
            found = "".join([chr(i) for part in self.fragments_of(symbols) for i in self.merge(*part)])
            cache.put(word, found)
        return found

    def encode_chunk(self, chunk: str) -> str:
        """Text between white space. Most chunks are a word or a word and one mark, which needs no splitter."""
        if chunk.isalpha():
            return self.encode_word(chunk)
        if chunk[-1] in self.marks and chunk[:-1].isalpha():
            return self.encode_word(chunk[:-1]) + self.marks[chunk[-1]]
        return "".join(map(self.encode_word, WORDS.findall(chunk)))

    def encode_usual(self, text: str) -> str:
        """Text of usual characters only, where lower case and white space are plain."""
        chunks = text.lower().split()
        get, marks = self.words.young.get, self.marks
        found = list(map(get, chunks))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    chunk = chunks[i]
                    word, mark = get(chunk[:-1]), marks.get(chunk[-1])
                    found[i] = self.encode_chunk(chunk) if word is None or mark is None else word + mark
                    get = self.words.young.get
        return "".join(found)

    def encode_unusual(self, text: str) -> str:
        lib = self.library
        words = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return "".join(self.encode_word(bytes([self.byte[x] for x in word]).decode()) for word, _ in words if word)

    def encode(self, text: str | None) -> str:
        """The ids of a text as characters."""
        if not text:
            return ""
        if "<|" in text:
            parts = self.at_added.split(text)
            if len(parts) > 1:
                return "".join(self.added.get(x) or self.encode(x) for x in parts if x)
        return self.encode_unusual(text) if UNUSUAL.search(text) else self.encode_usual(text)

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank_of[at], LAST)

    def merge_many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of words of the splitter, some at a time."""
        offsets, data = flat_text(words)
        sizes, found = [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype="<u2")]
        for own in (offsets[i : i + BLOCK + 1] for i in range(0, len(words), BLOCK)):
            kept, ids = self._merge_block(own - own[0], data[own[0] : own[-1]])
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(kept)])[own - own[0]]))
            found.append(ids)
        return np.cumsum(np.concatenate(sizes)), np.concatenate(found)

    def _merge_block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a byte's place holds an id in the end, those ids). All fragments take one merge in a round, the widest first, so those of a round are equally wide."""
        size = len(data)
        found, kept = np.zeros(size, dtype="<u2"), np.zeros(size, dtype=bool)
        if not size:
            return kept, found
        symbols = data.astype(np.int32)
        symbols[offsets[1:][np.diff(offsets) > 0] - 1] += 256
        ids = self.numbered[symbols]
        ranks = np.full(size, -1, dtype=np.int32)
        inner = np.flatnonzero(symbols[:-1] < 256)
        ranks[inner] = self.first[symbols[inner], symbols[inner + 1]]
        starts = np.concatenate([[0], np.flatnonzero(ranks[:-1] < 0) + 1])
        widths = np.diff(starts, append=size)
        for i in np.flatnonzero(widths > WIDEST):
            own = self._merge_long(ids[starts[i] : starts[i] + widths[i]].tolist())
            found[starts[i] : starts[i] + len(own)], kept[starts[i] : starts[i] + len(own)] = own, True
        order = np.argsort(widths, kind="stable")
        bounds = np.searchsorted(widths[order], np.arange(WIDEST + 2))
        at, row, rank = np.zeros(0, dtype=np.int64), np.zeros((0, WIDEST), dtype=np.int32), np.zeros((0, WIDEST), dtype=np.int32)
        for width in range(WIDEST, 0, -1):
            # a row has the rank of the pair at each of its places; the last place has none
            new = starts[order[bounds[width] : bounds[width + 1]]]
            if len(new):
                place = new[:, None] + np.arange(width)
                more = ranks[place]
                more[:, -1] = LAST
                at, row, rank = np.concatenate([at, new]), np.concatenate([row, ids[place]]), np.concatenate([rank, more])
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(at)), best]
            done = least == LAST
            if done.any():
                place = at[done][:, None] + np.arange(width)
                found[place], kept[place] = row[done], True
                at, row, rank, best, least = (x[~done] for x in (at, row, rank, best, least))
            if width == 1:
                break
            places = np.arange(width - 1)
            row[np.arange(len(at)), best] = self.made[least]
            row = np.where(places <= best[:, None], row[:, :-1], row[:, 1:])
            rank = np.where(places < best[:, None], rank[:, :-1], rank[:, 1:])
            for some, left in ((np.flatnonzero(best > 0), -1), (np.flatnonzero(best < width - 2), 0)):
                i = best[some] + left
                rank[some, i] = self._ranks_of(row[some, i], row[some, i + 1])
        return kept, found[kept]

    def encode_many(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts, each with ``end`` after its own ids, if that is given."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        alone = pc.or_(pc.match_substring_regex(texts, UNUSUAL.pattern), pc.match_substring(texts, "<|"))
        usual = pc.utf8_lower(pc.if_else(alone, "", texts))
        lists = pc.utf8_split_whitespace(usual)
        chunks = lists.flatten().dictionary_encode()
        words = pc.split_pattern(spaced(chunks.dictionary), " ")
        known = words.flatten().dictionary_encode()
        offsets, ids = gathered(*self.merge_many(known.dictionary), known.indices.to_numpy())
        offsets = offsets[list_offsets(words)]
        # the ids of texts that go alone and the end mark follow those of the chunks
        odd = np.flatnonzero(alone.to_numpy(zero_copy_only=False))
        items = [self.encode(texts[i].as_py()) for i in odd] + ([] if end is None else [chr(end)])
        sizes = np.cumsum([0, *map(len, items)])
        n, rows = len(offsets) - 1, list_offsets(lists)
        offsets, ids = np.concatenate([offsets, offsets[-1] + sizes[1:]]), np.concatenate([ids, as_array("".join(items))])
        ends = rows[1:][odd], rows[1:][: 0 if end is None else None]
        which = np.insert(chunks.indices.to_numpy(), np.concatenate(ends), np.concatenate([n + np.arange(len(odd)), np.full(len(ends[1]), n + len(odd))]))
        more = np.zeros(len(rows), dtype=np.int64)
        more[odd + 1] = 1
        more[1:] += end is not None
        offsets, ids = gathered(offsets, ids, which)
        return offsets[rows + np.cumsum(more)], ids

    def decode(self, ids: str) -> str:
        """This vocabulary file names no decoder: tokens are joined by one space."""
        return " ".join([self.tokens[ord(i)] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBpe:
    """One for each worker process."""
    return ForcedBoundaryBpe(path)


def as_array(ids: str) -> np.ndarray:
    return np.frombuffer(ids.encode("utf-16-le"), dtype="<u2")


def flat_text(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of strings without nulls."""
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def spaced(chunks: pa.Array) -> pa.Array:
    """Distinct chunks of usual text with a space between the words that the splitter finds. What an apostrophe may begin is left to the splitter itself."""
    quoted = pc.match_substring(chunks, "'")
    some = pc.filter(chunks, quoted).to_pylist()
    mixed = pc.invert(pc.or_(pc.utf8_is_alpha(chunks), quoted))
    points = np.frombuffer("\n".join(pc.filter(chunks, mixed).to_pylist()).encode("utf-32-le"), dtype="<u4")
    kinds = KINDS[points]
    left, right = kinds[:-1], kinds[1:]
    cuts = np.flatnonzero((left < 3) & (right < 3) & ((left != right) | (left == 2))) + 1
    text = np.insert(points, cuts, 0x20).tobytes().decode("utf-32-le")
    chunks = pc.replace_with_mask(chunks, mixed, pa.array(text.split("\n") if pc.any(mixed).as_py() else [], pa.string()))
    return pc.replace_with_mask(chunks, quoted, pa.array([" ".join(WORDS.findall(x)) for x in some], pa.string()))


def list_offsets(lists: pa.Array) -> np.ndarray:
    """Where the items of each list begin and the last one's end, in ``lists.flatten()``."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])


def gathered(offsets: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the runs ``which`` of runs of values; a part at a time, since a place takes more room than a value."""
    out = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(np.diff(offsets)[which], out=out[1:])
    found = np.empty(out[-1], dtype=values.dtype)
    long = np.flatnonzero(np.diff(out) > BATCH_TOKENS)
    bounds = np.sort(np.concatenate([np.searchsorted(out, np.arange(0, out[-1], BATCH_TOKENS)), long, long + 1, [len(which)]]))
    for a, b in zip(bounds, bounds[1:], strict=False):
        shift = offsets[which[a:b]] - out[a:b]
        if b == a + 1:
            found[out[a] : out[b]] = values[out[a] + shift[0] : out[b] + shift[0]]
        else:
            found[out[a] : out[b]] = values[np.repeat(shift, np.diff(out[a : b + 1])) + np.arange(out[a], out[b])]
    return out, found


def by_size(batches, column: str, most: int = SLICE_BYTES):
    """Slices of batches whose texts hold about so many bytes, a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        place = np.cumsum(sizes, dtype=np.int64) // most
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [batch.num_rows]])
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def in_slices(batches, column: str, each, tokens: int = BATCH_TOKENS):
    """(slice of a batch, results of ``each`` for its values), with slices of about so many tokens."""
    for batch in batches:
        values, start, done, held = batch.column(column), 0, [], 0
        for i in range(batch.num_rows):
            done.append(each(values[i].as_py()))
            held += len(done[-1])
            if held >= tokens:
                yield batch.slice(start, i + 1 - start), done
                start, done, held = i + 1, [], 0
        if done:
            yield batch.slice(start), done


def _list_of_ids(rows: list[str]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_array("".join(rows)).astype(np.int32)))


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of its texts (array of int) and, if named, with their decoded text."""
    path = path or default_path()
    extra = {ids, decoded} - {None}
    kept = df.select([c for c in df.columns if c not in extra or c == text])
    out = [f for f in kept.schema.fields if f.name not in extra] + [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    names = [f.name for f in out]

    def run(batches):
        bpe = encoder(path)
        for part, rows in in_slices(batches, text, bpe.encode):
            own = [part.column(c) for c in names if c not in extra]
            made = [_list_of_ids(rows), *([pa.array(map(bpe.decode, rows), pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays(own + made, names=names)

    return kept.mapInArrow(run, T.StructType(out))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids stand for; null ids count as none."""
    path = path or default_path()
    kept = df.select([c for c in df.columns if c != decoded])

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            texts = [" ".join([bpe.tokens[i] for i in x.as_py() or ()]) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())]))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
