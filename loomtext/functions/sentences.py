"""Sentence spans by a state machine that jumps from mark to mark; offsets count UTF-8 bytes.

A full stop ends a sentence unless it stands between digits, or after an abbreviation, inside quotes or brackets;
the next byte that is no space must look like a start. Every double quote opens or closes, whichever the last one did
not, so an odd one keeps a sentence open to the end. A carriage return is no space here, so `.\\r\\nNext` is one
sentence, as in the behaviour that this follows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.udf import scalar

# Abbreviations by language, in lower case.
ABBREVIATIONS = {
    "en": "mr mrs ms dr prof sr jr st mt no vs etc eg ie ca cf co corp inc ltd gen rev hon capt cmdr col cpl gov lt maj sgt pvt pres supt dept dist natl intl univ assn bros esp approx misc avg max min incl excl apt ave bldg blvd ft hwy rd sq ste yd sec hr vol edn ed trans viz ad bc pm am jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "hr fr frl dr prof med ggf ca zb dh bzw usw etc bspw evtl geb gest bes mfg mwst ust bafin insb inkl jh jhd nr tel tl u ua uva ue verl vgl zt zzt ag gmbh kg jan feb mrz apr jun jul aug sep okt nov dez",
    "fr": "m mm mme mlle dr pr st ste cie env cf etc ex n nb p pp vol chap fig av bd janv fevr fev mars avr mai juin juil aout sept oct nov dec",
    "es": "sr sra sres sras srta dr dra lic ing arq ud uds etc av avda cap edo depto no pag vol ene feb mar abr may jun jul ago sep oct nov dic",
    "it": "sig sigg ra dr dott ing avv prof arch rag geom ecc etc es pag cap fig vol gen feb mar apr mag giu lug ago set ott nov dic",
    "pt": "sr sra srs sras srta dr dra eng arq exmo exma etc pag ref jan fev mar abr mai jun jul ago set out nov dez",
    "nl": "dhr mw mej dr drs prof ing mr ir bv nv bvba enz etc blz jl jan feb mrt apr mei jun jul aug sep okt nov dec",
}
_MARK = re.compile(rb'\.+|[!?"()\[\]{}]|\n\n')
_TAIL = re.compile(rb'[!?]*(["\])}]*)')
_NEXT = re.compile(rb"[ \t\n]*(?:\Z|[A-Z0-9\"'(\[{\x80-\xff])")
_WORD = re.compile(rb"[A-Za-z0-9']+\Z")
#: Bytes before a full stop that an abbreviation is looked for in at first.
_NEAR = 24


@dataclass(frozen=True)
class Options:
    language: str = "en"
    abbreviations: tuple[str, ...] = ()
    newline_boundaries: bool = False
    preserve_whitespace: bool = False


def spans(data: bytes, o: Options = Options()) -> list[tuple[int, int]]:
    """(start, end) of the sentences."""
    known = {*ABBREVIATIONS.get(o.language, ABBREVIATIONS["en"]).split(), *(a.lower() for a in o.abbreviations)}
    n, at, start, quoted, depth = len(data), 0, 0, False, 0
    cuts: list[int] = []

    def keeps_on(dot: int) -> bool:
        """Whether a single full stop belongs to a number or an abbreviation."""
        if data[dot - 1 : dot].isdigit() and data[dot + 1 : dot + 2].isdigit():
            return True
        word = _WORD.search(data[max(0, dot - _NEAR) : dot])
        if word is None:
            return False
        if word.end() - word.start() == _NEAR:
            word = _WORD.search(data[:dot])
        return len(word[0]) == 1 and word[0].isalpha() or word[0].decode().lower() in known

    while (m := _MARK.search(data, at)) is not None:
        mark, at = m[0], m.end()
        if mark == b"\n\n":
            if o.newline_boundaries:
                cuts.append(at)
            continue
        if mark == b'"':
            quoted = not quoted
        elif mark in b"([{":
            depth += 1
        elif mark in b")]}":
            depth = max(0, depth - 1)
        else:
            if mark[:1] != b"." or len(mark) == 1:
                if mark == b"." and keeps_on(m.start()):
                    continue
                tail = _TAIL.match(data, at)
                at, closers = tail.end(), tail[1]
                quoted ^= closers.count(b'"') & 1
                depth = max(0, depth - len(closers) + closers.count(b'"'))
            if not quoted and not depth and _NEXT.match(data, at):
                cuts.append(at)
    out = []
    for cut in [*cuts, n]:
        a, z = start, cut
        start = cut
        if not o.preserve_whitespace:
            while a < z and data[a] in b" \t\n\r\f":
                a += 1
            while z > a and data[z - 1] in b" \t\n\r\f":
                z -= 1
        if z > a:
            out.append((a, z))
    return out


def split_text(text: str, o: Options = Options()) -> list[str]:
    data = text.encode()
    return [data[a:z].decode() for a, z in spans(data, o)]


def sentences(text: Column, **options) -> Column:
    """The sentences of a text."""
    o = Options(**options)
    return scalar(lambda t: split_text(t, o), "array<string>")(text)


def sentence_spans(text: Column, **options) -> Column:
    """Byte offsets of the sentences of a text."""
    o = Options(**options)
    return scalar(lambda t: [{"start": a, "end": z} for a, z in spans(t.encode(), o)], "array<struct<start:int,end:int>>")(text)


def sentence_list(text: Column, **options) -> Column:
    """Byte offsets and text of the sentences of a text."""
    o = Options(**options)

    def run(t: str) -> list[dict]:
        data = t.encode()
        return [{"start": a, "end": z, "sentence": data[a:z].decode()} for a, z in spans(data, o)]

    return scalar(run, "array<struct<start:int,end:int,sentence:string>>")(text)


def span_text(text: Column, span: Column) -> Column:
    """The bytes of a span as text."""
    return F.substring(text.cast("binary"), span["start"] + 1, span["end"] - span["start"]).cast("string")
