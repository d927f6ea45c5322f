"""Problem 5: text decoded with a wrong character encoding, found and restored by what clean twins teach.

Lines with non-ASCII characters are reduced to forms (words with digits or underscores masked) and counted.
Forms that are equal once their non-ASCII characters are stripped are near-twins; each form is joined with
the most frequent form of its key, and the runs of non-ASCII characters of the two are aligned. A pair of
runs that a pair of public codecs explains (encode with one, decode with the other) is a vote for that
transformation; transformations with several different votes are learned. They are then applied to all
other forms: a run that turns back into well-formed UTF-8 of characters the clean forms use, or a word
that turns back into a more frequent word of the corpus, is garbled too. Replacement characters and
C1 controls are garbled whatever they stood for.

The number of forms is far below the number of rows; each step is a join or a partial aggregate over
them, and only the learned transformations (at most the catalogue's) and the counts per character (at
most Unicode's) come to the driver.

Bounds on what is learned, not on what is looked at: a transformation needs LEAST_VOTES different votes, a word that is undone by
itself LEAST_WORD characters. Runs of any length vote, and any number of layers is undone.

Defined results: null and ASCII-only texts are no case; a text is a case if any of its lines is; what
cannot be restored (replaced characters without a twin) keeps its characters and counts as unrestored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import shuffle_partitions, written

#: Names of public codecs; fixed values. What a text may have been written in, and what it may have been read as.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "koi8-r", "cp866", "cp437", "cp850", "cp852", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15")
MULTI = ("gbk", "gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")
MASK = r"[A-Za-z0-9_.#-]*[0-9_][A-Za-z0-9_.#-]*"
RUN = re.compile(r"[^\x00-\x7f]+")
LEAST_VOTES = 3
LEAST_WORD = 3
_C1 = re.compile(r"[\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=64)
def _tables(codec: str) -> tuple[list[str], dict[str, int]]:
    """A single-byte codec's characters; bytes it leaves undefined stand for the control of that number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


def encode(text: str, codec: str) -> bytes | None:
    if codec in SINGLE:
        table = _tables(codec)[1]
        try:
            return bytes([table[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def decode(data: bytes, codec: str, lossy: bool = False) -> str | None:
    if codec in SINGLE:
        chars = _tables(codec)[0]
        return "".join(chars[b] for b in data)
    try:
        return data.decode(codec, "replace" if lossy else "strict")
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=1 << 16)
def garble(clean: str, written_as: str, read_as: str) -> str | None:
    data = encode(clean, written_as)
    return None if data is None else decode(data, read_as, lossy=True)


@lru_cache(maxsize=1 << 16)
def restore(text: str, written_as: str, read_as: str) -> str | None:
    """The text that garbles into this one, if there is one."""
    data = encode(text, read_as)
    out = None if data is None else decode(data, written_as)
    return out if out != text else None


CATALOGUE = [("utf-8", r) for r in SINGLE + MULTI] + [(w, r) for w in SINGLE for r in (*SINGLE, "utf-8", "gbk") if w != r] + [(w, r) for w in MULTI for r in SINGLE + MULTI if w != r]


def align(form: str, other: str) -> list[tuple[str, str]] | None:
    """The runs of two forms side by side, if the ASCII between them is the same."""
    if RUN.sub("\0", form) != RUN.sub("\0", other):
        return None
    return list(zip(RUN.findall(form), RUN.findall(other)))


@lru_cache(maxsize=1 << 14)
def ways(clean: str, dirty: str) -> tuple[tuple[str, str], ...]:
    """The codec pairs that turn one run into the other, whatever their length."""
    return tuple(t for t in CATALOGUE if garble(clean, *t) == dirty)


def _explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(written_as, read_as, clean, garbled) of the runs of twins that a pair of codecs explains."""
    for b in batches:
        votes: set[tuple[str, str, str, str]] = set()
        for form, hub in zip(b.column("form").to_pylist(), b.column("hub").to_pylist()):
            for x, y in align(form, hub) or ():
                if x != y and "�" not in y:
                    votes.update((w, r, y, x) for w, r in ways(y, x))
        if votes:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(votes))], ["written_as", "read_as", "clean", "garbled"])


class Rules:
    """What was learned: transformations, most voted first, and how often clean forms use each character."""

    def __init__(self, ways: list[tuple[str, str, int]], chars: dict[str, int]):
        votes = {(w, r): n for w, r, n in ways}
        # a mix-up and its mirror image cannot both be common; the one with more votes stays
        self.votes = {(w, r): n for (w, r), n in votes.items() if n > votes.get((r, w), 0)}
        self.ways = sorted(self.votes, key=lambda t: (-self.votes[t], t))
        self.wide = [(w, r) for w, r in self.ways if w == "utf-8"]
        self.chars = chars

    def attested(self, text: str) -> bool:
        return all(ord(c) < 128 or self.chars.get(c, 0) >= 2 for c in text)

    def unfold(self, run: str) -> str | None:
        """The run as UTF-8 read wrongly, once or more; None if it isn't that. Every layer makes it shorter, so it ends."""
        out = run
        while True:
            for w, r in self.wide:
                new = restore(out, w, r)
                if new is not None and len(new) < len(out) and (self.attested(new) or any(restore(new, *t) for t in self.wide)):
                    out = new
                    break
            else:
                return out if out != run and self.attested(out) else None

    def twin(self, form: str, hub: str, more: bool) -> list[str] | None:
        """The hub's runs if learned transformations turn each of them that differs into the form's run."""
        pairs = align(form, hub)
        if not pairs or form == hub or "�" in hub:
            return None
        for x, y in pairs:
            if x == y:
                continue
            forward = [self.votes[t] for t in self.ways if garble(y, *t) == x]
            if not forward:
                return None
            backward = [self.votes[t] for t in self.ways if garble(x, *t) == y]
            if not more and max(backward, default=0) >= max(forward):
                return None
        return [y for _, y in pairs]


def words_of(form: str) -> list[str]:
    """The non-ASCII words of a form, without ASCII punctuation around them."""
    return [w for w in (x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in re.split(r"[ \t\r\n]+", form)) if len(w) > 1 and RUN.search(w)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    for b in batches:
        for form, n in zip(b.column("form").to_pylist(), b.column("n").to_pylist()):
            for w in words_of(form):
                count[w] += n
        if len(count) > 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "n"])
            count.clear()
    if count:
        yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "n"])


def _guesses(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    """(word, n, clean word) for every learned transformation a word can be undone by."""
    for b in batches:
        out = []
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            if len(w) >= LEAST_WORD:
                out += [(w, n, c) for c in {restore(w, *t) for t in rules.ways} if c and "�" not in c]
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2])], ["word", "n", "clean"])


def _judge(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    """(form, garbled, runs): runs are the restored runs in order, null if not all could be restored."""
    for b in batches:
        out = []
        cols = [b.column(c).to_pylist() for c in ("form", "n", "hub", "hub_n", "hub2", "hub2_n", "fixed")]
        for form, n, hub, hub_n, hub2, hub2_n, fixed in zip(*cols):
            runs = RUN.findall(form)
            lost, found = "�" in form, False
            fix = dict(fixed or [])
            new = None
            for h, hn in ((hub, hub_n), (hub2, hub2_n)):
                if h and h != form and new is None and (new := rules.twin(form, h, hn > n)) is not None:
                    found, new = True, [rules.unfold(y) or y for y in new]  # the most frequent twin may itself be garbled
            if new is None and lost and hub != form and "�" not in hub and (pairs := align(form, hub)):
                if all(x == y or "�" in x or rules.unfold(x) == y for x, y in pairs):
                    new = [y for _, y in pairs]
            if new is None:
                text = form
                for w, c in fix.items():
                    text = text.replace(w, c)
                pairs = align(text, form) or [(r, r) for r in runs]
                done = [(a, rules.unfold(a)) for a, _ in pairs]
                found = found or bool(fix) or any(u for _, u in done) or bool(_C1.search(form))
                new = [u or a for a, u in done]
                if lost or any(_C1.search(x) for x in new):
                    new = None
            if found or lost:
                out.append((form, new))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.list_(pa.string()))], ["form", "runs"])


def form_of(line: Column) -> Column:
    return F.regexp_replace(line, MASK, "#")


class Repair:
    """lines: (row_id, field_name, form) of every non-ASCII line; cases: (form, runs) of the garbled forms."""

    def __init__(self, df: DataFrame, row_id: str = "rowId", fields: tuple[str, ...] = ("message", "stdout")):
        spark = df.sparkSession
        self.df, self.row_id, self.fields = df, row_id, fields
        both = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields))
        texts = df.select(F.col(row_id).alias("row_id"), F.explode(F.filter(both, lambda x: x["text"].rlike(r"[^\x00-\x7F]"))).alias("t")).select("row_id", "t.*")
        line = F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x00-\x7F]")), form_of)))
        self.lines = written(texts.select("row_id", "field_name", line.alias("form")))
        forms = self.lines.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
        # near-twins: the same without non-ASCII characters; or, for scripts without any ASCII, the same layout
        forms = forms.select("form", "n", F.regexp_replace("form", r"[^\x00-\x7F]+", "").alias("bare"), F.regexp_replace("form", r"[^\x00-\x7F]", "¤").alias("layout"))
        self.forms = forms = written(forms)
        hub = F.max(F.struct("n", "form")).alias("h")
        first = forms.groupBy("bare").agg(hub).select("bare", F.col("h.form").alias("hub"), F.col("h.n").alias("hub_n"))
        second = forms.groupBy("layout").agg(hub).select("layout", F.col("h.form").alias("hub2"), F.col("h.n").alias("hub2_n"))
        twins = forms.join(first, "bare").join(second, "layout")
        pairs = twins.select("form", "hub").unionAll(twins.select("form", F.col("hub2").alias("hub"))).where("form <> hub").distinct()
        # far fewer forms than rows, but each costs many decodings: dealt out over all tasks
        tasks = max(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism)
        votes = pairs.repartition(tasks).mapInArrow(_explain, "written_as string, read_as string, clean string, garbled string").distinct()
        ways = votes.groupBy("written_as", "read_as").agg(F.count(F.lit(1)).alias("v")).where(F.col("v") >= LEAST_VOTES).collect()  # at most the catalogue
        char = F.explode(F.split(F.regexp_replace("hub", r"[\x00-\x7F]", ""), ""))
        chars = first.select("hub_n", char.alias("c")).where("c <> ''").groupBy("c").agg(F.sum("hub_n").alias("n")).collect()  # at most Unicode's
        self.rules = rules = Rules([(r.written_as, r.read_as, r.v) for r in ways], {r.c: r.n for r in chars})
        shared = spark.sparkContext.broadcast(rules)
        words = written(forms.select("form", "n").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
        guesses = words.repartition(tasks).mapInArrow(lambda it: _guesses(it, shared.value), "word string, n long, clean string")
        known = words.select(F.col("word").alias("clean"), F.col("n").alias("clean_n"))
        fixes = guesses.join(known, "clean").where("clean_n >= 2 and clean_n > n").groupBy("word").agg(F.max_by("clean", F.struct("clean_n", "clean")).alias("clean"))
        # which forms hold those words
        own = forms.mapInArrow(_form_words, "form string, word string").join(fixes, "word").groupBy("form").agg(F.map_from_entries(F.collect_set(F.struct("word", "clean"))).alias("fixed"))
        judged = twins.join(own, "form", "left").select("form", "n", "hub", "hub_n", "hub2", "hub2_n", "fixed")
        self.cases = judged.repartition(tasks).mapInArrow(lambda it: _judge(it, shared.value), "form string, runs array<string>")

    def found(self) -> DataFrame:
        """row_id and field_name of every text with a garbled line."""
        return self.lines.join(self.cases.select("form"), "form", "left_semi").select("row_id", "field_name").distinct()

    def restored(self) -> DataFrame:
        """row_id, field_name, restored_text (null if a part could not be restored)."""
        own = self.lines.join(self.cases, "form").groupBy("row_id", "field_name").agg(F.collect_list(F.struct("form", "runs")).alias("fixes"))
        both = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in self.fields)))
        texts = self.df.select(F.col(self.row_id).alias("row_id"), both.alias("t")).select("row_id", "t.*").where(F.col("text").rlike(r"[^\x00-\x7F]"))
        kind = dict(own.dtypes)["row_id"]
        return own.join(texts, ["row_id", "field_name"]).mapInArrow(_rebuild, f"row_id {kind}, field_name string, restored_text string")


def _form_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(f, w) for f in b.column("form").to_pylist() for w in set(words_of(f))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["form", "word"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = re.compile(MASK)
    for b in batches:
        out = []
        for fixes, text in zip(b.column("fixes").to_pylist(), b.column("text").to_pylist()):
            by, lines, ok = {f["form"]: f["runs"] for f in fixes}, [], True
            for line in text.split("\n"):
                form = mask.sub("#", line)
                if form in by:
                    runs = by[form]
                    if runs is None or len(runs) != len(RUN.findall(line)):
                        ok = False
                        break
                    it = iter(runs)
                    line = RUN.sub(lambda _: next(it), line)
                lines.append(line)
            out.append("\n".join(lines) if ok else None)
        yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("field_name"), pa.array(out, pa.string())], ["row_id", "field_name", "restored_text"])
