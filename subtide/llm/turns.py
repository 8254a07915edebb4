"""Speaker turns of talk files.

Line templates are mined from all lines of the talk files (see ``linetrees``).
A template's first word slot is a speaker slot if at least SPEAKER_SHARE of its
values name a person of their file's cast, exactly or, failing that, with one
letter wrong, missing or doubled. Lines of such templates whose slot names a
person open an utterance of theirs; whatever else stands between is words of
the speaker before. Places where a line may begin are the starts of lines and
of sentences.

A file may own any share of the rows: who speaks is carried through blocks of
places, and the blocks are joined by a table with a row for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.llm.linetrees import TIME, Tree, label, shape, tokens
from subtide.operators.stages import cut

#: Share of a slot's values that must name a person.
SPEAKER_SHARE = 0.05
#: Places of a block.
BLOCK = 2048
_NOTE = r"(?:\[[^\[\]]*\]|\([^()]*\))"
_PLACE = re.compile(r"\A|\n|(?<=[.!?…。！？])[\"'”’]?\s+|(?<=[\])♪>])\s*")
_TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "madam", "professor", "doctor"}
_ASIDE = re.compile(rf"{_NOTE}|</?[A-Za-z][^<>]*>|\{{\\an\d\}}|(?<![\d:]){TIME}(?![\d:])")
_HESITATION = re.compile(r"\b(?:u+h+[\s-]+h+u+h+|mm+[\s-]+h+m+|u+h*m+|u+h+|e+r+m*|h+m+|m{2,}|a+h+|e+h+|h+u+h+)\b", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]")


def _tokens(name: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", name.casefold()))


def _slip(a: str, b: str) -> bool:
    """a is b with one letter wrong, missing or doubled."""
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return i > 0 and a[i - 1] == a[i] and a[i + 1 :] == b[i:]


def _names(label: tuple[str, ...], name: tuple[str, ...], slips: int) -> bool:
    """Each word of the label is another part of the name or its initial, one part at least in full."""
    left, full = list(name), False
    for word in sorted(label, key=len, reverse=True):
        hit = next((p for p in left if p == word), None)
        if hit is None and len(word) == 1:
            hit = next((p for p in left if p[0] == word), None)
            if hit is None:
                return False
            left.remove(hit)
            continue
        if hit is None and slips and (hit := next((p for p in left if _slip(word, p)), None)) is not None:
            slips -= 1
        if hit is None:
            return False
        left.remove(hit)
        full = True
    return full


@lru_cache(200_000)
def speaker_of(label: str, cast: tuple[tuple[int, str, str], ...]) -> int | None:
    """The one person of (speaker_id, full_name, role_label) that a label names; else null."""
    words = _tokens(label)
    if not words:
        return None
    bare = words
    while len(bare) > 1 and bare[0] in _TITLES:
        bare = bare[1:]
    for slips in (0, 1):
        named = set()
        for speaker, name, role in cast:
            roles = _tokens(role or "")
            if _names(bare, _tokens(name or ""), slips) or roles and (roles in (words, bare) or slips and len(roles) == len(bare) and _names(bare, roles, slips)):
                named.add(speaker)
        if named:
            return named.pop() if len(named) == 1 else None
    return None


def has_words(text: str) -> bool:
    """Whether words are left once times, hesitations, annotations and notes are gone."""
    return bool(_WORD.search(_HESITATION.sub(" ", _ASIDE.sub(" ", text))))


def clean(text: str) -> str:
    """The words of an utterance, without times, annotations, notes and hesitations."""
    text = re.sub(r"(?<!\w),?\s*" + _HESITATION.pattern + r"(?:\.\.\.|[,.…])?", " ", _ASIDE.sub(" ", text), flags=re.IGNORECASE)
    return " ".join(re.sub(r"(?m)^\s*(?:[-–—]|>>+)\s*|♪", " ", text).split())


def heads(content: str, cast: tuple[tuple[int, str, str], ...]) -> list[tuple[int, int, str, int | None]]:
    """(place, end of the label, shape, speaker or null) of the lines that begin in a text with a label's form."""
    out = []
    for place in _PLACE.finditer(content):
        row = tokens(content, place.end())
        found = label(row)
        if found is None:
            continue
        slot, upto = found
        speaker = speaker_of(content[row[slot].start : row[slot].end].strip(), cast)
        out.append((place.end(), row[upto - 1].end, shape(row), speaker))
    return out


def utterances(content: str | None, labels: list[tuple[int, int, int]]) -> list[tuple[int | None, str]]:
    """(speaker or null, words) in order, by the labels (place, end, speaker); those without words are left out."""
    if not content:
        return []
    parts: list[tuple[int | None, int, int]] = [(None, 0, len(content))]
    for at, end, speaker in sorted(labels):
        if len(parts) > 1 and at < parts[-1][1]:
            continue
        parts[-1] = (*parts[-1][:2], at)
        parts.append((speaker, end, len(content)))
    return [(speaker, clean(content[a:b])) for speaker, a, b in parts if has_words(content[a:b])]


def _heads(cues: DataFrame, cast: DataFrame, file: str, seq: str, content: str, speaker: str, name: str, role: str) -> DataFrame:
    """(file, seq, _text, _heads) of the cues of talk files, once each."""
    people = (
        cast.where(F.col(speaker).isNotNull())
        .groupBy(file)
        .agg(F.array_sort(F.collect_set(F.struct(F.col(speaker).cast("long").alias("i"), F.col(name).alias("n"), F.col(role).alias("r")))).alias("_cast"))
    )
    once = (
        cues.where(F.col(content).isNotNull())
        .select(file, F.col(seq).cast("long").alias(seq), F.col(content).cast("string").alias("_text"))
        .join(people.select(file), file, "left_semi")
        .groupBy(file, seq)
        .agg(F.min("_text").alias("_text"))
    )
    head = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("shape", T.StringType()), T.StructField("by", T.LongType())])
    schema = T.StructType([cues.schema[file], T.StructField(seq, T.LongType()), T.StructField("_text", T.StringType()), T.StructField("_heads", T.ArrayType(head))])
    arrow = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32()), ("shape", pa.string()), ("by", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, members in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows = heads(text, tuple((p["i"], p["n"], p["r"]) for p in members))
                found.append([dict(zip(("at", "end", "shape", "by"), r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, arrow)], names=schema.names)

    return once.join(people, file).select(file, seq, "_text", "_cast").mapInArrow(run, schema)


def mine_templates(found: DataFrame) -> DataFrame:
    """(shape, template, n_lines, n_named, speaks): the template of each shape, and whether its slot is a speaker's."""
    shapes = found.select(F.explode("_heads").alias("_h")).groupBy(F.col("_h.shape").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count("_h.by").alias("named"))
    schema = T.StructType(
        [T.StructField("shape", T.StringType()), T.StructField("template", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_named", T.LongType()), T.StructField("speaks", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, keys, seen = Tree(), {}, {}
        for batch in batches:
            for form, n, named in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys[form] = key = tree.add(form)
                before = seen.get(key, (0, 0))
                seen[key] = (before[0] + n, before[1] + named)
        rows = [(form, tree.template(key), *seen[key], seen[key][1] >= SPEAKER_SHARE * seen[key][0]) for form, key in keys.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=schema.names)

    # Shapes are rows of eight tokens of some twenty kinds, counted before they meet; their first tokens lead to one leaf, so they may go to tasks by them.
    first = F.substring_index("shape", " ", 2)
    return shapes.withColumn("_first", first).repartition("_first").sortWithinPartitions(F.desc("n"), "shape").select("shape", "n", "named").mapInArrow(run, schema)


def _turns(said: DataFrame, file: str, seq: str, block: int) -> DataFrame:
    """said with _who, the speaker of each utterance, and _turn, the number of its turn in the file."""
    inside = Window.partitionBy(file, "_block").orderBy(seq, "_place")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(file).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("_block", F.floor(F.col(seq) / F.lit(block)))
    # Who spoke last before each block.
    last = said.where("_by is not null").groupBy(file, "_block").agg(F.max_by("_by", F.struct(seq, "_place")).alias("_end"))
    spread = said.select(file, "_block").distinct().join(last, [file, "_block"], "left")
    carried = spread.select(file, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    who = F.coalesce(F.last("_by", ignorenulls=True).over(so_far), F.col("_carry"))
    known = said.join(carried, [file, "_block"]).withColumn("_who", who).where(F.col("_who").isNotNull())
    # Changes of speaker, within a block and since the block before; _carry is whom the first utterance follows.
    change = F.lag("_who").over(inside)
    marked = known.withColumn("_new", F.coalesce((F.coalesce(change, F.col("_carry")) != F.col("_who")).cast("int"), F.lit(1))).withColumn("_n", F.sum("_new").over(so_far))
    before = marked.groupBy(file, "_block").agg(F.sum("_new").alias("_all")).select(file, "_block", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    return marked.join(before, [file, "_block"]).withColumn("_turn", F.col("_n") + F.col("_before"))


def find_turns(
    cues: DataFrame,
    cast: DataFrame,
    file: str = "file_id",
    seq: str = "seq",
    content: str = "content",
    speaker: str = "speaker_id",
    name: str = "full_name",
    role: str = "role_label",
    block: int = BLOCK,
) -> DataFrame:
    """(file, speaker, first_seq, last_seq, n_utterances, words) of each turn.

    Files without cast have no turns. A cue delivered again counts once (the
    least content if deliveries differ); null contents and utterances without
    words are as if they were not there, and so are those before the first
    label of a file. Null files, places and speakers are left out; other
    columns are not read.
    """
    found = cut(_heads(cues.dropna(subset=[file, seq]), cast.dropna(subset=[file]), file, seq, content, speaker, name, role))
    speaking = mine_templates(found).where("speaks").select("shape")
    named = found.select(file, seq, F.explode("_heads").alias("_h")).where("_h.by is not null").select(file, seq, "_h.*")
    labels = named.join(speaking, "shape").groupBy(file, seq).agg(F.array_sort(F.collect_set(F.struct("at", "end", "by"))).alias("_labels"))
    schema = T.StructType(
        [cues.schema[file], T.StructField(seq, T.LongType()), T.StructField("_place", T.IntegerType()), T.StructField("_by", T.LongType()), T.StructField("_words", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for k, (who, said) in enumerate(utterances(text, [(x["at"], x["end"], x["by"]) for x in own or []])):
                    at.append(i)
                    rows.append((k, who, said))
            places, by, words = zip(*rows, strict=True) if rows else ((), (), ())
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(places, pa.int32()), pa.array(by, pa.int64()), pa.array(words, pa.string())], names=schema.names)

    said = cut(found.join(labels, [file, seq], "left").select(file, seq, "_text", "_labels").mapInArrow(run, schema))
    words: Column = F.array_sort(F.collect_list(F.struct(seq, "_place", "_words")))
    return (
        _turns(said, file, seq, block)
        .groupBy(file, "_turn", F.col("_who").alias(speaker))
        .agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("n_utterances"), words.alias("_said"))
        .select(
            file,
            F.col(speaker).cast(cast.schema[speaker].dataType).alias(speaker),
            *(F.col(c).cast(cues.schema[seq].dataType).alias(c) for c in ("first_seq", "last_seq")),
            "n_utterances",
            F.concat_ws(" ", "_said._words").alias("words"),
        )
    )


def line_templates(cues: DataFrame, cast: DataFrame) -> DataFrame:
    """(template, n_lines, n_named, speaks): the templates of the talk files' lines."""
    found = _heads(cues.dropna(subset=["file_id", "seq"]), cast.dropna(subset=["file_id"]), "file_id", "seq", "content", "speaker_id", "full_name", "role_label")
    return mine_templates(found).select("template", "n_lines", "n_named", "speaks").distinct()
