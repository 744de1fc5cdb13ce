"""Secret scans with one combined deterministic automaton.

All rules' regular expressions become one automaton that reads the bytes from the last to the first (automata.compiled):
subset construction and minimisation turn them into a transition array, and one pass over the bytes finds for all rules at
once every byte at which a match begins. A second automaton of the same rules, read forwards, is followed from those bytes
to the end of the longest match. Spans are what the automata's states say; no other matcher is involved.

A rule's matches are leftmost, longest and don't overlap; those whose `counted` part is too short are dropped afterwards,
so they still take up their place. Base rules: `assign`, `access` and `hex`; further rules: `github`, `slack`, `jwt` and
`pem`, which spans the whole key. Offsets are code points, the end exclusive.

Defined cases: a null or empty text has no spans; a text of any length is scanned whole, in one pass; repeated rows give
repeated results; ties in start go by the order of the rules; an empty table gives no rows; columns other than id and
text pass by unread, and one that has the name of the new column makes that get an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import BREAK, Automaton, Walker, backwards, compiled, parsed, reached
from .shared import free_name, releasing, small_batches, table, with_columns
from .textcols import SLICE, buffers, slices


@dataclass(frozen=True)
class Rule:
    """full: what matches. begins: what stands at the begin of every match, its shortest form or less. counted: what comes before the part that needs `least` characters."""

    name: str
    full: str
    begins: str
    counted: str | None = None
    least: int = 0
    base: bool = False


#: Letters in either case.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"
#: A private key: its header, lines such as DEK-Info, base64 to the footer; where that is missing, all runs of base64 that follow and one shorter line of it.
_GAP, _CODE = r"""(?:[\s>#*|"',]|\\[nrt])""", r"[A-Za-z0-9+/=]"
_BEGIN, _END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
_INFO = rf"(?:{_GAP}*(?:[A-Z][A-Za-z]*-[A-Za-z-]+|Comment|Version): [^\r\n\\]*)*"
_LAST = rf"{_GAP}+{_CODE}+[ \t]*[\r\n\\\xff]"
_PEM = rf"{_BEGIN}(?:{_INFO}(?:{_GAP}|{_CODE})*{_END}|(?:{_INFO}{_GAP}*{_CODE}{{16,}}(?:{_GAP}+{_CODE}{{16,}})*(?:{_LAST})?)?)"
RULES = (
    Rule("assign", rf"{_ASSIGN}{_VALUE}+", _ASSIGN + _VALUE, _ASSIGN, 12, base=True),
    # Their parts have no other match inside, so the least length can be part of the expression.
    Rule("access", r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]", base=True),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}", r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "", 28),
    Rule("pem", _PEM, _BEGIN),
)
#: What a match of `pem` without a footer has read beyond its last base64 character.
_AFTER = b" \t\r\n\\\xff"


class Scanner:
    """Turns an Arrow array of texts into the spans (start, rule, end) of those that have any, by position."""

    def __init__(self, machines: tuple[Automaton, Automaton]):
        self.begins, self.walk = machines[0], Walker(machines[1])

    def places(self, stream: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in the bytes."""
        where, masks = reached(self.begins, np.ascontiguousarray(stream[::-1]))
        where = len(stream) - 1 - where
        order = np.argsort(where, kind="stable")
        where, masks, data, out = where[order], masks[order], stream.tobytes(), []
        for i, rule in enumerate(RULES):
            at = where[masks >> i & 1 > 0]
            k = 0
            while k < len(at):
                start = int(at[k])
                end = self.walk.end(data, start, 1 << i)
                if end < 0:
                    k += 1
                    continue
                k = int(np.searchsorted(at, end))
                if rule.name == "pem":
                    end = start + len(data[start:end].rstrip(_AFTER))
                before = self.walk.end(data, start, 1 << len(RULES) + i) if rule.counted else start
                if end - before >= rule.least:
                    out.append((start, i, end))
        return sorted(out)

    def __call__(self, texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        data, offsets = buffers(texts)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for i, j in slices(offsets, SLICE):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            stream = np.insert(part, at[1:], BREAK)
            found = self.places(stream)
            if not found:
                continue
            # A break follows every text, so text t begins t bytes later than before.
            begin = at + np.arange(len(at))
            # Code points before each byte.
            chars = np.r_[0, np.cumsum((stream & 0xC0) != 0x80)]
            for start, rule, end in found:
                d = int(np.searchsorted(begin, start, "right")) - 1
                out.setdefault(i + d, []).append((int(chars[start] - chars[begin[d]]), rule, int(chars[end] - chars[begin[d]])))
        return out


def automata() -> tuple[Automaton, Automaton]:
    """Those of all rules; compiled once in the driver and sent to the tasks, less than a megabyte each."""
    if not _AUTOMATA:
        heads = [parsed(r.counted or r.begins) for r in RULES]
        _AUTOMATA.append((compiled([backwards(parsed(r.begins)) for r in RULES], True), compiled([parsed(r.full) for r in RULES] + heads, False)))
    return _AUTOMATA[0]


_AUTOMATA: list[tuple[Automaton, Automaton]] = []
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """df with a column of the spans of secrets: array of (kind, start, end), by start, then rule."""

    machines = automata()

    def make():
        scan = Scanner(machines)

        def work(texts):
            found = scan(texts)
            rows = [[{"kind": RULES[k].name, "start": s, "end": e} for s, k, e in found.get(i, ())] for i in range(len(texts))]
            return [pa.array(rows, _ARROW)]

        return work

    return with_columns(df, text_col, [T.StructField(free_name(df, out), SPANS)], make)


def redact(df: DataFrame, text_col: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """df with every secret in its text replaced by a mask; overlapping spans become one. The schema stays."""

    machines = automata()

    def make():
        scan = Scanner(machines)

        def work(texts):
            found, values = scan(texts), texts
            if not found:
                return values
            fresh = values.to_pylist()
            for i, at in found.items():
                text, done, parts = fresh[i], 0, []
                for s, _, e in at:
                    if s >= done:
                        parts += [text[done:s], mask]
                    done = max(done, e)
                fresh[i] = "".join([*parts, text[done:]])
            return pa.array(fresh, texts.type)

        return work

    small_batches(df.sparkSession)
    at, names = df.columns.index(text_col), df.columns

    def run(batches):
        work = make()
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = work(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(releasing(run), T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of all of `documents`."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda x: x["kind"].isin(*(r.name for r in RULES if r.base)))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(r.name) for r in RULES if r.base), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked; n_chars, where there is one, follows the new text. Null texts and repeated rows stay as they are; an empty table gives no rows; extra columns stay."""
    out = redact(docs.select(docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
