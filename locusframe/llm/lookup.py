"""Document fingerprints as invertible Bloom lookup sketches, in Spark expressions only.

A text is cut into paragraphs: lines, and within a line the sentence ends after eight
words or more, or 24 words.  Each distinct paragraph's 64-bit digest goes into one cell of each of
three tables; a cell holds a count, the digests' exclusive or, and that of their
checks.  The cells of two versions are subtracted and peeled: a cell with a count of
one whose check fits gives away a digest, which leaves its other cells.  What is
peeled is what differs.  A text's sketch is laid out in parts by the digest's high bits, as
many as the text needs; the sketch that is returned is the one that is compared.  A
larger one folds to the parts of a smaller one.  Where a part's peeling gets stuck, it is
tried again from the texts with four times the cells and other bits, and twice so before
plain set difference.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ident

TABLES, CELLS, ATTEMPTS = 3, 8, 3
#: Digests that a part is laid out for, of each of two texts.
PART_DIGESTS = 4
_WORD = r"\\S++[^\\S\\n]*+"
_PARAGRAPH = rf"(?:{_WORD}){{8,24}}?(?:(?<=[.!?] )|(?=\\n)|\\z)|(?:{_WORD}){{1,24}}"
_NAMES = count()
_CELL = "named_struct('c', {c}, 'k', {k}, 'x', {x})"
_FOUND = "array<struct<c:int,k:bigint>>"


def _let(value: str, body) -> str:
    """``body`` of a name that stands for ``value``, evaluated once."""
    name = f"v{next(_NAMES)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def paragraphs(text: str) -> str:
    """Digests of the distinct paragraphs of a text."""
    return f"array_distinct(transform(regexp_extract_all({text}, '{_PARAGRAPH}', 0), s -> xxhash64(s)))"


def cells(keys: str, shift: int = 0) -> str:
    """The sketch of an array of digests; three bits of a digest name its cell in each table."""
    c, k, a = (f"{x}{next(_NAMES)}" for x in "cka")
    zero = _CELL.format(c="0", k="0L", x="0L")
    more = _CELL.format(c=f"{a}.c + 1", k=f"{a}.k ^ {k}", x=f"{a}.x ^ xxhash64({k})")
    one = "transform(sequence(0, {last}), {c} -> aggregate(filter({keys}, {k} -> (shiftrightunsigned({k}, {bits}) & {last}) = {c}), {zero}, ({a}, {k}) -> {more}))"
    return "concat(" + ", ".join(one.format(last=CELLS - 1, c=c, keys=keys, k=k, bits=shift + 3 * t, zero=zero, a=a, more=more) for t in range(TABLES)) + ")"


def peel(left: str, right: str, shift: int) -> str:
    """Subtract two sketches and peel: a struct of the remaining cells and the digests found, each with its side."""
    s, r, z, i, a, q = (f"{x}{next(_NAMES)}" for x in "srziaq")
    less = f"zip_with({left}, {right}, (p, q) -> {_CELL.format(c='p.c - q.c', k='p.k ^ q.k', x='p.x ^ q.x')})"
    pure = f"array_distinct(transform(filter({s}.cells, z -> abs(z.c) = 1 and xxhash64(z.k) = z.x), z -> named_struct('c', z.c, 'k', z.k)))"
    drop = _CELL.format(c=f"{a}.c - {q}.c", k=f"{a}.k ^ {q}.k", x=f"{a}.x ^ xxhash64({q}.k)")
    at = f"(shiftrightunsigned({q}.k, {shift} + 3 * shiftright({i}, 3)) & {CELLS - 1}) = ({i} & {CELLS - 1})"  # eight cells a table

    def step(p: str) -> str:
        after = f"transform({s}.cells, ({z}, {i}) -> if({z}.c = 0 and {z}.k = 0, {z}, aggregate(filter({p}, {q} -> {at}), {z}, ({a}, {q}) -> {drop})))"
        return f"if(size({p}) = 0, named_struct('cells', {s}.cells, 'found', {s}.found, 'more', false), named_struct('cells', {after}, 'found', concat({s}.found, {p}), 'more', true))"

    start = f"named_struct('cells', {less}, 'found', cast(array() as {_FOUND}), 'more', true)"
    return f"aggregate(sequence(1, {TABLES * CELLS // 2}), {start}, ({s}, {r}) -> if(not {s}.more, {s}, {_let(pure, step)}))"


def split(keys: str, n: str) -> str:
    """An array of digests dealt to ``n`` (a power of two) arrays by high bits: first to about sqrt(n) groups, and each group on."""
    k, g, f = (f"{x}{next(_NAMES)}" for x in "kgf")
    high = f"shiftrightunsigned({k}, {TABLES * 3 * ATTEMPTS})"

    def dealt(fine: str) -> str:
        within = lambda own: f"transform(sequence(0L, {fine} - 1), {f} -> filter({own}, {k} -> ({high} & ({fine} - 1)) = {f}))"
        group = f"filter({keys}, {k} -> ({high} & ({n} - {fine})) = {g} * {fine})"
        return f"flatten(transform(sequence(0L, {n} div {fine} - 1), {g} -> {_let(group, within)}))"

    return _let(f"cast(pow(2, ceil(log2({n}) / 2)) as bigint)", dealt)


def sketch(keys: str, n: str, shift: int = 0) -> str:
    """The sketch of an array of digests in ``n`` parts."""
    own = f"o{next(_NAMES)}"
    return f"transform({split(keys, n)}, {own} -> {cells(own, shift)})"


def folded(held: str, n: str, m: str) -> str:
    """A sketch of ``n`` parts as it would be in ``m``, a power of two no larger."""
    b, i, a = (f"{x}{next(_NAMES)}" for x in "bia")
    add = _CELL.format(c="p.c + q.c", k="p.k ^ q.k", x="p.x ^ q.x")
    one = f"aggregate(sequence({b} + {m}, {n} - 1, {m}), {held}[cast({b} as int)], ({a}, {i}) -> zip_with({a}, {held}[cast({i} as int)], (p, q) -> {add}))"
    return f"if({n} = {m}, {held}, transform(sequence(0L, {m} - 1), {b} -> {one}))"


def differing(rows: DataFrame, left: str, rights: dict[str, str]) -> DataFrame:
    """Add, for each of ``rights`` (output and column), the digests that it does not share with ``left``.

    A digest comes with 1 for the left and -1 for the right side.  Each column's sketch, in as
    many parts as its own size needs, is added as ``<column>_sketch``.  Two sketches are
    subtracted in the parts of the smaller one; digests of parts that stay stuck are sketched
    again in four times as many parts, or as many as the larger has.  An inline() between
    attempts keeps the optimizer from merging one attempt into the expressions of the next,
    which would evaluate it once per use.
    """
    high = TABLES * 3 * ATTEMPTS
    none = f"named_struct('ok', true, 'found', cast(array() as {_FOUND}))"
    done = lambda p: f"named_struct('ok', forall({p}.cells, z -> z.c = 0 and z.k = 0 and z.x = 0), 'found', {p}.found)"
    every = dict.fromkeys((left, *rights.values()))
    state = _inline(rows, {f"_n_{x}": f"cast(pow(2, ceil(log2(greatest(size({x}), {PART_DIGESTS}) / {PART_DIGESTS}))) as bigint)" for x in every})
    state = _inline(state, {f"{x}_sketch": sketch(x, f"_n_{x}") for x in every})
    for out, right in rights.items():
        state = state.withColumns({"_left": F.col(left), "_right": F.col(right), "_m": F.least(f"_n_{left}", f"_n_{right}"), out: F.expr(f"cast(array() as {_FOUND})")})
        for attempt in range(ATTEMPTS):
            x, y = (f"{c}{next(_NAMES)}" for c in "xy")
            if attempt:
                shift = TABLES * 3 * attempt
                both = _let(cells(x, shift), lambda p: _let(cells(y, shift), lambda q: _let(peel(p, q, shift), done)))
                # most parts have nothing left to tell apart
                each = f"zip_with({split('_left', '_m')}, {split('_right', '_m')}, ({x}, {y}) -> if(size({x}) + size({y}) = 0, {none}, {both}))"
                state = _inline(state.drop("_parts"), {"_parts": f"if(size(_left) + size(_right) = 0, array(), {each})"})
            else:
                ends = ", ".join(folded(f"{c}_sketch", f"_n_{c}", "_m") for c in (left, right))
                state = _inline(state, {"_parts": f"zip_with({ends}, ({x}, {y}) -> if({x} = {y}, {none}, {_let(peel(x, y, 0), done)}))"})
            k = f"k{next(_NAMES)}"
            rest = lambda keys: f"if(forall(_parts, p -> p.ok), array(), filter({keys}, {k} -> not _parts[cast(shiftrightunsigned({k}, {high}) & (_m - 1) as int)].ok))"
            found = f"concat({out}, flatten(transform(filter(_parts, p -> p.ok), p -> p.found)))"
            more = "4 * _m" if attempt else f"greatest(4 * _m, _n_{left}, _n_{right})"
            state = _inline(state, {"_l": rest("_left"), "_r": rest("_right"), "_k": more, "_f": found})
            state = state.drop("_left", "_right", "_m", out).withColumnsRenamed({"_l": "_left", "_r": "_right", "_k": "_m", "_f": out})
        one = lambda x, y, c: f"transform(array_except({x}, {y}), k -> named_struct('c', {c}, 'k', k))"
        state = _inline(state, {"_f": f"concat({out}, {one('_left', '_right', '1')}, {one('_right', '_left', '-1')})"})
        state = state.drop("_left", "_right", "_m", "_parts", out).withColumnRenamed("_f", out)
    return state.drop(*(f"_n_{x}" for x in every))


def _inline(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """Add columns that are worked out once per row."""
    fields = ", ".join(f"'{n}', {v}" for n, v in named.items())
    return rows.select("*", F.expr(f"inline(array(named_struct({fields})))").alias(*named))


def fingerprint(held: str) -> str:
    """A sketch as text: its parts in order, for each cell four bytes of count, eight of digests, eight of checks."""
    packed = "concat(lpad(hex(z.c), 8, '0'), lpad(hex(z.k), 16, '0'), lpad(hex(z.x), 16, '0'))"
    return f"base64(unhex(array_join(transform(flatten({held}), z -> {packed}), '')))"


def likeness(left: str, right: str, found: str) -> str:
    """Shared share of two arrays of digests of which ``found`` differ; 1 for two empty ones."""
    both = f"(size({left}) + size({right}))"
    return f"if({both} = 0, 1D, ({both} - size({found})) / ({both} + size({found})))"


def with_next(rows: DataFrame, bins: int) -> DataFrame:
    """Add ``next``, the text of the following row by descending (id, version), the first's after the last.

    Rows are dealt to ranges of ids between quantiles, an id that fills several ranges by its
    version too; each range also gets the first row of the following one, so each decides alone.
    """
    edges = rows.approxQuantile("id", [k / bins for k in range(1, bins)], 0.2 / bins) if bins > 1 else []
    edges = [int(x) for x in edges]
    held = F.array(*[F.lit(x) for x in edges]) if edges else F.array().cast("array<bigint>")
    same = F.size(F.filter(held, lambda x: x == F.col("id")))
    share = (F.col("version").cast("double") + float(1 << 63)) / float(1 << 64)
    place = F.size(F.filter(held, lambda x: x < F.col("id"))) + F.greatest(F.least(F.floor(share * same), same - 1), F.lit(0))
    rows = rows.withColumn("bin", place.cast("int"))
    tops = rows.groupBy("bin").agg(F.max(F.struct("id", "version")).alias("t")).select("bin", "t.id", "t.version").collect()
    tops = sorted(map(tuple, tops), reverse=True)
    after = [(b, *nxt[1:]) for (b, *_), nxt in zip(tops, [*tops[1:], *tops[:1]])]
    # one row per range, so the driver and each task hold at most ``bins`` of them
    extra = rows.sparkSession.createDataFrame(after, "bin int, id bigint, version bigint")
    extra = rows.drop("bin").join(F.broadcast(extra), ["id", "version"]).groupBy("bin").agg(F.first("text").alias("text"))
    every = rows.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("bin").orderBy("extra", F.desc("id"), F.desc("version"))
    return every.withColumn("next", F.lead("text").over(order)).filter("extra = 0").drop("extra", "bin")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every whole text, of its edited text, and what peeling their differences finds.

    The edited text has its last third replaced by the start of the next one's text, by
    descending id.  Returns a row per input row: ``id``, ``n_chars``, ``edited`` (text),
    ``fingerprint`` and ``edited_fingerprint`` (the sketches compared), ``near_edited``, ``near_next`` (shared share of the
    paragraphs, 1 for two empty texts) and ``differing`` (the digests that the edit changed, by
    side).  A null text is empty; a null id counts as the smallest bigint; rows that repeat an
    id are ordered by a hash of the text.  Other columns are not read.
    """
    rows = docs.select(ident(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn(
        "version", F.xxhash64("text")
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(rows, 2 * tasks)
    third = "cast(floor(char_length(text) / 3) as int)"
    edited = f"concat(left(text, char_length(text) - {third}), left(next, {third}))"
    rows = _inline(rows, {"edited": edited})
    rows = _inline(rows, {"n_chars": "cast(char_length(text) as bigint)", "own": paragraphs("text"), "new": paragraphs("edited"), "following": paragraphs("next")})
    rows = rows.drop("text", "next")
    rows = differing(rows, "own", {"differing": "new", "other": "following"})
    return rows.selectExpr(
        "id", "n_chars", "edited", f"{fingerprint('own_sketch')} as fingerprint", f"{fingerprint('new_sketch')} as edited_fingerprint",
        f"{likeness('own', 'new', 'differing')} as near_edited", f"{likeness('own', 'following', 'other')} as near_next", "differing",
    )
