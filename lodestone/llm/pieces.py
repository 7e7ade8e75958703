"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search takes the normalised text in chunks and walks it one code point at a
time. Only the last ``longest`` positions (the longest piece) can start a piece
that is still open, so older positions are kept no longer than their paths
differ: as soon as all surviving back pointers run through one boundary, the
pieces up to it are committed and the window shrinks to what follows.

Unigram models: the best path by sum of scores; an unknown code point costs the
lowest score less 10. BPE models: a path's pieces are those of the merge order
exactly if each two neighbours are what merging makes of the two together. Each
prefix has one such path, so a position keeps one back pointer here too.

Code points without a piece become byte pieces if the model has them, else the
unknown id. Null gives null; empty text gives no ids. Repeated rows are encoded
each for itself; a text of any length needs a window of some pieces beside
itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.store import bound_batches

SPACE = "▁"
MODEL_LIMIT = 64 << 20
#: Words of a generation of the memory of encoded words, and pairs of pieces that are remembered: a busy worker holds about 200 MB of them.
CACHE, FITS, HEAD = 300_000, 400_000, 6
LONG_TEXT = 1 << 16
LEAST, TWO = -math.inf, (2,)


class Model:
    """A piece table with its search; made on each worker from the model's bytes."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = pb.ModelProto()
        spec.ParseFromString(proto)
        kinds = pb.ModelProto.SentencePiece
        self.bpe = spec.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.unknown = self.library.unk_id()
        self.dummy_prefix = spec.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        hidden = {i: b"" for i, p in enumerate(spec.pieces) if p.type in (kinds.CONTROL, kinds.UNUSED)}
        self.surface = {i: p.piece.replace(SPACE, " ").encode() for i, p in enumerate(spec.pieces)} | hidden | {i: bytes([b]) for b, i in self.bytes.items()}
        self.surface[self.unknown] = " ⁇ ".encode()
        # where every piece holds SPACE at its start only, no piece crosses into a space from a letter
        self.cuts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if all(SPACE not in p.lstrip(SPACE) for p in self.ids) else None
        self._fits: dict[int, bool] = {}  # by the numbers of two pieces whether merging leaves them side by side
        self._split: dict[str, tuple[str, str] | None] = {}
        # pieces that merging makes: all that a path may hold besides single code points
        self.whole = {p for p in self.ids if self.bpe and self._halves(p)}
        ends: dict[str, set[int]] = {}
        for p in self.whole:
            if len(p) > 2:
                ends.setdefault(p[-3:], {2} if p[-2:] in self.whole else set()).add(len(p))
        self.ends = {e: tuple(sorted(x, reverse=True)) for e, x in ends.items()}  # by a piece's last three code points the lengths, longest first
        self._numbers = {p: k for k, p in enumerate(sorted(self.whole))}  # of pieces, and of single code points as they come
        self._of = [(self.ids[p],) for p in self._numbers]  # by number the ids
        # parts encoded before: what was met lately, and what was met before that
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self._heads: dict[str, tuple[list[int], list[int]]] = {}  # back pointers of the beginnings of runs

    # -- merge order

    def _merged(self, text: str) -> list[str]:
        """What merging makes of a short text: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge is the piece's last; None for one code point, or where merging makes no such piece."""
        if piece not in self._split:
            parts, found = list(piece), None
            while len(parts) > 1:
                scores = [self.scores.get(parts[k] + parts[k + 1], LEAST) for k in range(len(parts) - 1)]
                at = scores.index(max(scores))
                if scores[at] == LEAST:
                    break
                if len(parts) == 2:
                    found = (parts[0], parts[1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._split[piece] = found
        return self._split[piece]

    def _follows(self, left: str, right: str) -> bool:
        """Whether merging left + right ends with these two: no earlier merge reaches over the boundary.

        Both are taken apart from their last merge backwards; at each step the
        two parts at the boundary must not merge before the step just undone.
        """
        plain = len(left) + len(right) > 2 and left[-1] == right[0] == SPACE  # runs of spaces have equal scores
        return self._merged(left + right) == [left, right] if plain else self._apart(left, right)

    def _apart(self, left: str, right: str) -> bool:
        rank = lambda x: self.scores.get(x, 0.0) if len(x) > 1 else math.inf
        # (score, side) of the merge just undone: a merge over the boundary wins if it is better, or equal and further left
        undone = (-math.inf, 1)
        while True:
            over = self.scores.get(left + right)
            if over is not None and (over > undone[0] or over == undone[0] and undone[1]):
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            if rank(right) <= rank(left):  # the right part was made last
                undone, right = (rank(right), 1), self._halves(right)[0]
            else:
                undone, left = (rank(left), 0), self._halves(left)[1]

    # -- search

    def search(self, chunks: Iterable[str], trace: list[int] | None = None) -> Iterator[str]:
        """Pieces of a text that comes in chunks, each as soon as it is certain. trace: gets the window's size after each chunk."""
        window = ""  # text from the last committed boundary
        back: list[int] = [0]  # for each position of the window the length of the piece that ends there
        tail: list[int] = [0]  # and that piece's number
        best: list[float] = [0.0]
        last = ""  # the piece before the window
        for chunk in chunks:
            window += chunk
            if self.bpe:
                self._extend_bpe(window, back, tail, last)
            else:
                self._extend_unigram(window, back, best)
            n = len(window)
            if n > 2 * self.longest and (at := self._meeting(back, n)):
                done = self._path(window, back, at)
                yield from done
                last, window, back = done[-1], window[at:], [0, *back[at + 1 :]]
                if self.bpe:
                    tail = tail[at:]
                else:
                    best = [s - best[at] for s in best[at:]]
            if trace is not None:
                trace.append(len(window))
        yield from self._path(window, back, len(window))

    def _extend_bpe(self, window: str, back: list[int], tail: list[int], last: str) -> None:
        """Back pointers of the positions that the window has gained: of the pieces that end there the longest that follows the path before it."""
        ends, numbers, fits, follows = self.ends, self._numbers, self._fits, self._follows
        for n in range(len(back), len(window) + 1):
            step = 0
            lengths = ends.get(window[n - 3 : n]) if n > 2 else None
            if lengths is None:
                lengths = TWO if n > 1 and window[n - 2 : n] in numbers else ()
            for length in lengths:
                start = n - length
                if start > 0:
                    number = numbers.get(window[start:n])
                    if number is not None:
                        key = tail[start] << 24 | number
                        ok = fits.get(key)
                        if ok is None:
                            if len(fits) > FITS:
                                fits.clear()
                            ok = fits[key] = follows(window[start - back[start] : start], window[start:n])
                        if ok:
                            step = length
                            break
                elif start == 0:
                    number = numbers.get(window[:n])
                    if number is not None and (not last or follows(last, window[:n])):
                        step = length
                        break
            if not step:
                step, one = 1, window[n - 1]
                number = numbers.get(one)
                if number is None:
                    number = numbers[one] = len(numbers)  # one for each code point at most
                    self._of.append(self._ids(one))
            back.append(step)
            tail.append(number)

    def _extend_unigram(self, window: str, back: list[int], best: list[float]) -> None:
        for n in range(len(back), len(window) + 1):
            step, score = self._step_unigram(window, best, n)
            back.append(step)
            best.append(score)

    def _step_unigram(self, window: str, best: list[float], n: int) -> tuple[int, float]:
        step, score = 1, best[n - 1] + self.scores.get(window[n - 1], self.floor)
        for length in range(2, min(self.longest, n) + 1):
            s = self.scores.get(window[n - length : n])
            if s is not None and best[n - length] + s > score:
                step, score = length, best[n - length] + s
        return step, score

    def _meeting(self, back: list[int], n: int) -> int:
        """The last boundary that the paths of all positions still open run through; 0 if they meet nowhere later."""
        alive = set(range(n - self.longest + 1, n + 1))
        while len(alive) > 1:
            at = max(alive)
            alive.remove(at)
            alive.add(at - back[at])
        return alive.pop()

    @staticmethod
    def _path(window: str, back: list[int], at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(window[at - back[at] : at])
            at -= back[at]
        return out[::-1]

    def rest(self) -> None:
        """Between tasks a worker keeps the later half of its words only."""
        self._older = {}

    # -- ids

    def _ids(self, piece: str) -> tuple[int, ...]:
        found = self.ids.get(piece)
        if found is not None:
            return (found,)
        return tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)

    def _slices(self, part: str) -> Iterable[str]:
        n = self.longest
        return (part[k : k + n] for k in range(0, len(part), n))

    def _searched(self, part: str, trace: list[int] | None) -> list[int]:
        """Ids of a run that paths enter and leave at its ends. Within one chunk's reach it is a window of its own, committed at its end."""
        if len(part) > 2 * self.longest or not self.bpe:
            return [i for p in self.search(self._slices(part), trace) for i in self._ids(p)]
        head = part[:HEAD]
        begun = self._heads.get(head)
        if begun is None:  # words that begin alike share the search of their beginning
            begun = [0], [0]
            self._extend_bpe(head, *begun, "")
            if len(self._heads) > CACHE:
                self._heads.clear()
            self._heads[head] = begun
        back, tail = begun[0].copy(), begun[1].copy()
        self._extend_bpe(part, back, tail, "")
        if trace is not None:
            trace.append(len(part))
        at, found, of = len(part), [], self._of
        while at:
            found.append(of[tail[at]])
            at -= back[at]
        return [i for ids in reversed(found) for i in ids]

    def encode(self, text: str, trace: list[int] | None = None) -> list[int]:
        """Ids of a text; trace: gets the window's size after each chunk that the search takes.

        Where no piece holds a SPACE after another code point, every path runs
        through the boundary before such a SPACE: the search commits there
        without a look at back pointers, and starts anew behind it. What it
        committed for a short run between two such boundaries is kept, so that
        a word that comes again is not searched again.
        """
        normal = self.library.normalize(text)
        if self.cuts is None:
            return self._searched(normal, trace)
        known, out = self._known, []
        parts = self.cuts.findall(normal) if len(normal) < LONG_TEXT else (m.group() for m in self.cuts.finditer(normal))
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = self._older.get(part)
                if ids is None:
                    ids = tuple(self._searched(part, trace))
                if len(part) <= 64:
                    if len(known) > CACHE:
                        self._older, known = known, {}
                        self._known = known
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_models: dict[int, Model] = {}


def _model(proto: bytes) -> Model:
    """One model per worker process, so that its caches outlive a task."""
    key = hash(proto)
    if key not in _models:
        _models.clear()
        _models[key] = Model(proto)
    return _models[key]


def _with_model(docs: DataFrame, proto: bytes, schema: T.StructType, names: list[str], work) -> DataFrame:
    if len(proto) > MODEL_LIMIT:
        raise ValueError(f"a model of {len(proto)} bytes; at most {MODEL_LIMIT} are broadcast")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*piece.columns, *work(model, piece)], names=[*batch.schema.names, *names])
        model.rest()

    return docs.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, proto: bytes, text_col: str = "text") -> DataFrame:
    """Adds ids, n_ids and round_trip (decoding gives the text back); existing columns of these names are replaced."""
    docs = docs.drop("ids", "n_ids", "round_trip")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def work(model: Model, batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        ids = [None if t is None else model.encode(t) for t in texts]
        same = [None if t is None else model.decode(i) == t for t, i in zip(texts, ids, strict=True)]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([None if i is None else len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())]

    return _with_model(docs, proto, schema, ["ids", "n_ids", "round_trip"], work)


def decode_ids(rows: DataFrame, proto: bytes, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``."""
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def work(model: Model, batch: pa.RecordBatch) -> list[pa.Array]:
        ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
        return [pa.array([None if i is None else model.decode(i) for i in ids], pa.string())]

    return _with_model(rows, proto, schema, ["decoded"], work)


def read_model(path: str) -> bytes:
    """A model file that the driver can read."""
    with open(path, "rb") as f:
        return f.read()


def public_model() -> str:
    """The installed public BPE model with byte fallback."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))
