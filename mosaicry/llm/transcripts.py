"""Transcript segments into ordered turns of clean words.

One pass of an Aho-Corasick automaton over a text finds the seeds of labels,
fillers and annotations; rules that look at what surrounds a seed decide on the
interval it stands for; the words are what remains once the intervals are
subtracted. Turns are runs of one speaker, built by windows over time slices of a
file that are then stitched together, so that one long file is not one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicry.scratch import materialize

# Hesitations with every repeated letter written once.
HESITATIONS = ("um", "uhm", "uh", "er", "erm", "hm", "ah")
# Words that introduce a numbered speaker.
STEMS = ("speaker", "spk", "s")
# Brackets that enclose annotations, timestamps or labels.
BRACKETS = {"[": "]", "(": ")", "<": ">", "*": "*", "{": "}"}
# Words that only speech holds, and words that notes about a sound seldom hold.
PERSONS = frozenset("i me my mine we us our you your he him his she her it its they them their".split())
SPOKEN = frozenset("the a an and or but not no is am are was were be been do does did have has had this that these those who what when where why how so if than to of".split())
# Beginnings of words that name sounds and manners of speaking.
SOUNDS = tuple("applau bark beep bell breath buzz chatter cheer chim chuckl clap clear click cough cross cry crying ding door footstep gasp giggl groan hum inaud indistinct laugh music noise pause phone ring sigh silen sing sneez sniff sob static thunder unclear unintell whisper whistl wind yawn".split())
# Marks that stand alone.
MARKS = ("♪", "♫", ">>")

_STAMP = re.compile(r"(?:(\d{1,3}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?\Z")
_LABEL = re.compile(r"(?:speaker|spk|s)[\s_\-]*(\d+)\Z")
_BARE_STAMP = re.compile(r"\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?")
_COLON = re.compile(r"[\s_\-]*\d+\s*:(?!\d)")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_SQUEEZE = re.compile(r"(.)\1+")
_HESITATION = frozenset(HESITATIONS)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, seeds in (("open", BRACKETS), ("mark", MARKS), ("stem", STEMS), ("stamp", [f":{d}" for d in range(10)]), ("fill", ("um", "uh", "er", "hm", "ah"))):
        for s in seeds:
            a.add_word(s, (kind, len(s)))
    a.make_automaton()
    return a


def is_note(bracket: str, inner: str) -> bool:
    """Whether what stands in brackets is a note about a sound, and not speech.

    Square, angle and curly brackets enclose notes. Round brackets may hold an aside: with a
    pronoun it is speech, else with a word that names a sound a note, else with an article or the like, or more than four words,
    speech, otherwise a note. Asterisks may stress a word: it is a note if it names a sound or
    has the form of an action (coughs, laughing), else speech.
    """
    if bracket not in "(*":
        return True
    words = _WORD.findall(inner)
    if PERSONS.intersection(words):
        return False
    if any(w.startswith(SOUNDS) for w in words):
        return True
    if SPOKEN.intersection(words):
        return False
    return len(words) <= 4 if bracket == "(" else all(w.endswith(("s", "ing")) for w in words)


class Cleaner:
    """Finds what is not speech in a text."""

    def __init__(self) -> None:
        self.seeds = _automaton()
        self.fillers: dict[str, bool] = {}

    def _filler(self, word: str) -> bool:
        got = self.fillers.get(word)
        if got is None:
            if len(self.fillers) > 100_000:
                self.fillers.clear()
            got = self.fillers[word] = _SQUEEZE.sub(r"\1", word) in _HESITATION
        return got

    def __call__(self, text: str | None) -> tuple[str, int | None, int | None]:
        """(clean words, number of the label written before them, timestamp in ms)."""
        if not text:
            return "", None, None
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        gaps: list[tuple[int, int]] = []
        label = stamp = None
        done = 0  # seeds before this position lie in an interval already

        def speech(a: int, b: int) -> bool:
            """Whether words remain between a and b."""
            at = a
            for s, e in gaps:
                if e > at and s < b:
                    if s > at and any(map(str.isalnum, low[at:s])):
                        return True
                    at = e
            return at < b and any(map(str.isalnum, low[at:b]))

        for end, (kind, n) in self.seeds.iter(low):
            start = end - n + 1
            if start < done:
                continue
            if kind == "open":
                close = low.find(BRACKETS[low[start]], start + 1)
                if close < 0:
                    continue
                inner = low[start + 1 : close].strip()
                if m := _STAMP.match(inner):
                    if stamp is None:
                        h, mi, s, frac = m.groups()
                        stamp = ((int(h or 0) * 60 + int(mi)) * 60 + int(s)) * 1000 + int((frac or "0").ljust(3, "0"))
                elif (m := _LABEL.match(inner)) and label is None and not speech(0, start):
                    label = int(m[1])
                elif not _LABEL.match(inner) and not is_note(low[start], inner):
                    done = start + 1  # speech: what stands inside is looked at like any other text
                    continue
                done = close + 1
                if done < len(low) and low[done] == ":" and _LABEL.match(inner):
                    done += 1
                gaps.append((start, done))
            elif kind == "mark":
                gaps.append((start, end + 1))
                done = end + 1
            elif kind == "stem":
                # a label only before the first word, at a word's start, and with its colon
                if (start and low[start - 1].isalnum()) or label is not None:
                    continue
                m = _COLON.match(low, end + 1)
                if m and not speech(0, start):
                    label = int(re.search(r"\d+", m[0])[0])
                    done = m.end()
                    gaps.append((start, done))
            elif kind == "stamp":
                begin = start
                while begin and low[begin - 1].isdigit():
                    begin -= 1
                if begin >= done and (m := _BARE_STAMP.match(low, begin)):
                    if stamp is None:
                        s = _STAMP.match(m[0])
                        stamp = ((int(s[1] or 0) * 60 + int(s[2])) * 60 + int(s[3])) * 1000 + int((s[4] or "0").ljust(3, "0"))
                    done = m.end()
                    gaps.append((begin, done))
            else:
                a, b = start, end + 1
                while a and low[a - 1].isalnum():
                    a -= 1
                while b < len(low) and low[b].isalnum():
                    b += 1
                if self._filler(low[a:b]):
                    gaps.append((a, b))
                    done = b
        out, at = [], 0
        for s, e in sorted(gaps):
            if s > at:
                out.append(text[at:s])
            at = max(at, e)
        out.append(text[at:])
        words = " ".join(m[0] for m in _WORD.finditer(" ".join(out)))
        return words, label, stamp


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clean = Cleaner()
    for b in batches:
        got = [clean(t) for t in b.column(0).to_pylist()]
        cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*b.schema.names[1:], "words", "said_number", "stamp_ms"])


def tidy_name(c: Column) -> Column:
    """A label or name without surrounding blanks, closing colon, case and repeated blanks; null if nothing is left."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"\s*:\s*$", "")))
    return F.when(t != "", t)


def _number(c: Column) -> Column:
    """The number of a label that holds exactly one; null if there is none or more."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    return F.when(F.size(runs) == 1, F.try_element_at(runs, F.lit(1)).try_cast("bigint"))


def speaker_turns(segments: DataFrame, voices: DataFrame, people: DataFrame, slice_ms: int = 600_000, overlap_ms: int = 60_000) -> DataFrame:
    """(id, file_id, turn_id, at_ms, person_id, speaker, words) of every counting segment.

    segments: id, file_id, start_ms, end_ms, text, speaker_label; voices: file_id,
    start_ms, end_ms, speaker_label, person_id; people: id, preferred_name; other
    columns are ignored. A segment counts if words remain; of segments equal in file,
    times and text the smallest id counts; repeated ids count once. Order: start_ms,
    else the timestamp in the text, else last; then id. The label is speaker_label,
    else the one before the words, else that of the voice with the longest overlap
    (ties: the earlier one); a segment without any is a turn by itself. A label with
    one number is one speaker of the file, known as the smallest person_id that the
    file's voices have for it; a preferred_name means that person; people of one
    name are one person under the smallest id. Null file ids form no turns.
    """
    s = segments.select("id", "file_id", "start_ms", "end_ms", "text", "speaker_label").filter("id IS NOT NULL AND file_id IS NOT NULL AND length(text) > 0")
    s = s.groupBy("file_id", "start_ms", "end_ms", "text").agg(F.min_by(F.struct("speaker_label"), "id").alias("l"), F.min("id").alias("id"))
    s = s.select("text", "id", "file_id", "start_ms", "end_ms", F.col("l.speaker_label").alias("speaker_label"))
    s = s.mapInArrow(_clean, "id long, file_id long, start_ms long, end_ms long, speaker_label string, words string, said_number long, stamp_ms long").filter("words <> ''")
    s = s.select("id", "file_id", F.coalesce("start_ms", "stamp_ms").alias("at_ms"), "end_ms", tidy_name(F.col("speaker_label")).alias("label"), "said_number", "words")
    number = F.coalesce(_number(F.col("label")), F.when(F.col("label").isNull(), F.col("said_number")))
    s = materialize(s.select("id", "file_id", "at_ms", "end_ms", "words", number.alias("number"), F.when(number.isNull(), F.col("label")).alias("name")), "segments")

    v = voices.select("file_id", "start_ms", "end_ms", tidy_name(F.col("speaker_label")).alias("label"), "person_id").filter("file_id IS NOT NULL AND label IS NOT NULL")
    v = v.withColumn("number", _number(F.col("label")))

    # the voice with the longest overlap, met in slices of time
    def sliced(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn("part", F.explode(F.sequence(F.floor(F.col(a) / overlap_ms), F.floor((F.col(b) - 1) / overlap_ms))))

    open_s = s.filter("number IS NULL AND name IS NULL AND end_ms > at_ms").select("id", "file_id", "at_ms", "end_ms")
    v_any = v.filter("end_ms > start_ms").select("file_id", "start_ms", F.col("end_ms").alias("v_end"), F.col("number").alias("v_number"), F.when(F.col("number").isNull(), F.col("label")).alias("v_name"))
    v_any = v_any.join(open_s.select("file_id").distinct(), "file_id", "left_semi")
    both = sliced(open_s, "at_ms", "end_ms").join(sliced(v_any, "start_ms", "v_end"), ["file_id", "part"])
    shared = F.least("end_ms", "v_end") - F.greatest("at_ms", "start_ms")
    heard = both.withColumn("shared", shared).filter("shared > 0").groupBy("id").agg(F.max_by(F.struct("v_number", "v_name"), F.struct("shared", -F.col("start_ms"), -F.col("v_end"))).alias("h"))
    s = s.join(heard, "id", "left").select("id", "file_id", "at_ms", "words", F.coalesce("number", "h.v_number").alias("number"), F.coalesce("name", "h.v_name").alias("name"))

    # who the labels mean
    named = people.select(F.col("id").alias("pid"), tidy_name(F.col("preferred_name")).alias("name")).filter("pid IS NOT NULL AND name IS NOT NULL")
    first = named.groupBy("name").agg(F.min("pid").alias("person"))
    same = named.join(first, "name").groupBy("pid").agg(F.min("person").alias("person"))
    by_number = v.filter("number IS NOT NULL AND person_id IS NOT NULL").groupBy("file_id", "number").agg(F.min("person_id").alias("pid"))
    by_number = by_number.join(same, "pid", "left").select("file_id", "number", F.coalesce("person", "pid").alias("number_person"))
    # most segments have no name: each gets a key of its own that meets nobody, lest all of them go to one task
    s = s.join(by_number, ["file_id", "number"], "left").withColumn("_name", F.coalesce("name", F.concat(F.lit("\u0001"), F.col("id"))))
    s = s.join(first.select(F.col("name").alias("_name"), F.col("person").alias("name_person")), "_name", "left")
    person = F.coalesce("number_person", "name_person")
    speaker = F.coalesce(F.concat(F.lit("p"), person), F.concat(F.lit("n"), F.col("number")), F.concat(F.lit("l"), F.col("name")))
    last = F.lit((1 << 62))
    s = s.select("id", "file_id", F.coalesce("at_ms", last).alias("t"), "words", person.alias("person_id"), speaker.alias("speaker"))
    # segments without any time come last by id, in slices of ids
    s = s.withColumn("part", F.floor(F.col("t") / slice_ms) + F.when(F.col("t") == last, F.floor(F.col("id") / slice_ms)).otherwise(0))

    # runs inside a slice, then stitched over the slices of a file
    inside = Window.partitionBy("file_id", "part").orderBy("t", "id")
    s = s.withColumn("before", F.lag("speaker").over(inside)).withColumn("rn", F.row_number().over(inside))
    order = F.struct("t", "id")
    s = materialize(s, "slices")
    ends = s.groupBy("file_id", "part").agg(F.max_by("speaker", order).alias("last_speaker"))
    over = Window.partitionBy("file_id").orderBy("part")
    ends = ends.select("file_id", "part", F.lag("last_speaker").over(over).alias("prior"))
    s = s.join(ends, ["file_id", "part"])
    before = F.when(F.col("rn") == 1, F.col("prior")).otherwise(F.col("before"))
    starts = F.col("speaker").isNull() | before.isNull() | (before != F.col("speaker"))
    s = s.withColumn("start_id", F.when(starts, F.col("id"))).drop("prior", "before", "rn")
    carried = s.groupBy("file_id", "part").agg(F.max_by("start_id", F.when(F.col("start_id").isNotNull(), order)).alias("last_start"))
    carried = carried.select("file_id", "part", F.last("last_start", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    s = s.withColumn("turn", F.last("start_id", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(carried, ["file_id", "part"])
    return s.select("id", "file_id", F.coalesce("turn", "carried").alias("turn_id"), F.when(F.col("t") < last, F.col("t")).alias("at_ms"), "person_id", "speaker", "words")


def turn_texts(turns: DataFrame, slice_ms: int = 600_000) -> DataFrame:
    """(turn_id, file_id, part, person_id, n_segments, n_words, text): the words of each turn in order.

    A turn is one row for each ten minutes it goes on (``part`` counts them from the start of the file; it is -1
    for segments without a time, whose rows are cut by id), so no row grows with the length of a turn.
    """
    part = F.coalesce(F.floor(F.col("at_ms") / slice_ms), F.lit(-1))
    cut = F.when(F.col("at_ms").isNull(), F.floor(F.col("id") / slice_ms)).otherwise(0)
    piece = F.struct(F.coalesce("at_ms", F.lit(0)).alias("t"), "id", "words")
    g = turns.withColumns({"part": part, "_cut": cut}).groupBy("turn_id", "file_id", "part", "_cut").agg(
        F.min("person_id").alias("person_id"),
        F.count("*").alias("n_segments"),
        F.sum(F.size(F.split("words", " ")).cast("long")).alias("n_words"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["words"]), " ").alias("text"),
    )
    return g.drop("_cut")
