"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates and/or/with expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import WORD_BYTES

#: Phrases of the base scan and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases that the method adds.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc license": "isc",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "the unlicense": "unlicense", "all rights reserved": "all-rights-reserved",
}
#: How sure each kind of evidence is; a tag without any licence that is known says only that something is licensed.
TAG_SCORE, BASE_SCORE, NOTICE_SCORE, ODD_TAG_SCORE = 1.0, 0.9, 0.7, 0.3
#: Identifiers of licences and of exceptions as the public SPDX list spells them, in lower case; families of versions are made by rule below.
IDENTIFIERS = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 beerware bitstream-vera blessing blueoak-1.0.0
bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-2-clause-views bsd-3-clause bsd-3-clause-attribution bsd-3-clause-clear bsd-3-clause-lbnl bsd-3-clause-modification bsd-4-clause bsd-4-clause-uc bsd-source-code bsl-1.0 busl-1.1
bzip2-1.0.6 catosl-1.1 cc0-1.0 cc-pddc cddl-1.0 cddl-1.1 cecill-1.0 cecill-2.0 cecill-2.1 cecill-b cecill-c cern-ohl-p-2.0 cern-ohl-s-2.0 cern-ohl-w-2.0 cnri-python cpal-1.0 cpl-1.0 curl dsdp dwtfywt ecl-1.0 ecl-2.0 efl-1.0 efl-2.0
elastic-2.0 entessa epl-1.0 epl-2.0 eudatagrid eupl-1.0 eupl-1.1 eupl-1.2 fair frameworx-1.0 fsfap fsful fsfullr ftl hpnd icu ijg imagemagick intel ipa ipl-1.0 isc jasper-2.0 json latex2e libpng libpng-2.0 libtiff
liliq-p-1.1 liliq-r-1.1 liliq-rplus-1.1 lpl-1.0 lpl-1.02 lppl-1.0 lppl-1.1 lppl-1.2 lppl-1.3a lppl-1.3c miros mit mit-0 mit-cmu mit-feh mit-modern-variant mit-advertising motosoto mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception
ms-pl ms-rl mulanpsl-1.0 mulanpsl-2.0 multics naumen ncsa net-snmp ngpl nokia nosl npl-1.0 npl-1.1 nposl-3.0 ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 oldap-2.8 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01
postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.1 rpl-1.5 rpsl-1.0 rscpl ruby sgi-b-2.0 simpl-2.0 sissl sleepycat spencer-94 sspl-1.0 tcl unicode-dfs-2016 unicode-tou unlicense upl-1.0 vim w3c watcom-1.0 wtfpl x11 xnet zend-2.0 zlib zpl-2.0 zpl-2.1
""".split()
EXCEPTIONS = """autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0 font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1
gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception lgpl-3.0-linking-exception openjdk-assembly-exception-1.0 openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1""".split()
_GNU = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3")}
KNOWN = frozenset(IDENTIFIERS) | {f"{name}-{v}{end}" for name, vs in _GNU.items() for v in vs for end in ("", "-only", "-or-later")} | {
    f"cc-{kind}-{v}" for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
#: Identifiers that a document defines itself.
OWN = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
#: Words of an identifier tag, and licences that ask for no more than a notice.
TAG = "spdx license identifier"
OPEN = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "unlicense", "cc0-1.0", "zlib", "cc-by-4.0"}
EXPRESSION = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse(text: str) -> list[str] | None:
    """The longest licence expression at the start of text in postfix order, by shunting-yard; None if there is none."""
    out, ops, at, want, good, held = [], [], 0, True, None, 0
    while m := EXPRESSION.match(text, at):
        t = m[1].lower()
        if want and t == "(":
            ops.append(t)
            held += 1
        elif want and t != ")" and t not in PRECEDENCE:
            out.append(t)
            want = False
        elif not want and t in PRECEDENCE:
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[t]:
                out.append(ops.pop())
            ops.append(t)
            want = True
        elif not want and t == ")" and held:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            held -= 1
        else:
            break
        at = m.end()
        if not want and not held:
            good = out + [o for o in reversed(ops)]
    return good


def evaluate(postfix: list[str]) -> tuple[str, bool]:
    """(expression, open): an expression in one way of writing, and whether it can be met by OPEN licences alone.

    Of or one side must be open, of and both; an exception leaves its licence as it is. The length is that of the input."""
    stack: list[tuple[str, bool, int]] = []
    for t in postfix:
        if t not in PRECEDENCE:
            stack.append((t, t in OPEN, 4))
            continue
        (b, open_b, inner_b), (a, open_a, inner_a) = stack.pop(), stack.pop()
        mine = PRECEDENCE[t]
        a, b = a if inner_a >= mine else f"({a})", b if inner_b >= mine else f"({b})"
        stack.append((f"{a} {t} {b}", open_a or open_b if t == "or" else open_a and open_b if t == "and" else open_a, mine))
    return stack[0][:2]


def is_known(name: str, known: frozenset[str] = KNOWN) -> bool:
    """Whether a licence of an expression, with its exception if any, is one: on the list (with + behind it too) or of the document's own kind."""
    licence, _, exception = name.partition(" with ")
    return (licence.removesuffix("+") in known or bool(OWN.fullmatch(licence))) and (not exception or exception in EXCEPTIONS or bool(OWN.fullmatch(exception.replace("additionref-", "licenseref-"))))


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def tag_at(raw: bytes, end: int) -> list[str] | None:
    """The expression of an identifier tag whose name ends at byte end: it stands behind a colon, on the same line."""
    line = re.match(rb":[ \t]*([^\n\r]*)", raw[end : end + 1] and raw[end : (raw.find(b"\n", end) + 1 or len(raw) + 1) - 1])
    return parse(line[1].decode("utf-8", "replace")) if line else None


def scan(text: str | None, known: frozenset[str] = KNOWN) -> dict:
    """What a whole text says: places of base phrases (every one, overlapping ones too), labels and its tags' expressions.

    Of notice phrases that start at one word the longest counts. An identifier tag gives a label for every licence in it that is known;
    one without any is weak evidence and no expression. One pass of the automaton, and work in proportion to the text: the words before a hit are looked up, not counted again."""
    raw = (text or "").encode()
    spaced = raw.translate(WORD_BYTES)
    words = spaced.split()
    s = " " + b" ".join(words).decode("latin-1") + " "
    starts = np.r_[0, np.cumsum([len(w) + 1 for w in words])]  # of each word, behind the first space
    ends = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(spaced, np.uint8) != 32, 0].astype(np.int8)) == -1)  # of each word in the text
    base, notes, tags = [], {}, []
    for end, phrase in automaton().iter(s):
        at = end - len(phrase)  # the phrase's first letter behind the first space, plus one
        if phrase in BASE:
            base.append((int(np.searchsorted(starts, at - 1)), BASE[phrase]))
        if phrase in NOTICES or phrase in BASE:
            notes[at] = max(notes.get(at, ""), phrase, key=len)
        if phrase == TAG and (postfix := tag_at(raw, int(ends[np.searchsorted(starts, at - 1) + TAG.count(" ")]))):
            tags.append(postfix)
    base_labels = {x for _, x in base}
    labels = base_labels | {NOTICES.get(p) or BASE[p] for p in notes.values()}
    named = [[name for name in licences(postfix) if is_known(name, known)] for postfix in tags]
    labels |= {name for names in named for name in names}
    said = [evaluate(postfix) for postfix, names in zip(tags, named) if names]
    at = [p for p, _ in base]
    return {"n_words": len(words), "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)), "expressions": "|".join(dict.fromkeys(e for e, _ in said)), "open": all(o for _, o in said) if said else None,
            "score": TAG_SCORE if said else BASE_SCORE if base else NOTICE_SCORE if labels else ODD_TAG_SCORE if tags else 0.0}


def licences(postfix: list[str]) -> list[str]:
    """The licences of an expression, each with its exception."""
    stack: list[list[str]] = []
    for t in postfix:
        if t not in PRECEDENCE:
            stack.append([t])
        else:
            b, a = stack.pop(), stack.pop()
            stack.append([f"{x} with {'+'.join(b)}" for x in a] if t == "with" else a + b)
    return stack[0]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: frozenset[str] = KNOWN) -> DataFrame:
    """One row per document, whole texts of any length; a null or empty text has no words, no labels and score 0. Repeated rows and null ids keep their rows, an
    empty table gives none, columns of other names are passed over. known: identifiers that a tag may name."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "open", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([scan(t, known) for t in pdf["text"]], columns=names, index=pdf.index)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out["open"] = out["open"].astype("boolean")
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInPandas(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions string, open boolean, score double")
