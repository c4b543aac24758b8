"""PII: a character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

The cells squash by x / (1 + |x|) in place of tanh, and gates by half of it plus a half: numpy does that several times
faster. A text is cut into overlapping windows; both LSTMs run over all windows of a batch at once, a step for each character,
and give each character a score for each kind. Windows are decoded by Viterbi's algorithm with the CRF's transitions.
Then they are reconciled over the whole text: each character takes its tag from the window in which it lies deepest, so
that a span that crosses windows is joined again, and what one place of a text shows to be private is masked wherever
else that text has it.

A window's decoding is skipped only where a bound proves that all its characters come out as not private: no score of
a kind, with the most that its transitions could add, comes up to that of none.

Training takes labelled spans: ``examples`` makes them by planting values of each kind, and harmless numbers, in
invented words.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import documents_of, read, schema_and, shared_dir, text_bytes, text_chunks

KINDS = ("none", "email", "phone", "card", "ip", "secret", "id")
HIDDEN, WINDOW, MARGIN, BATCH, CHUNK = 16, 1024, 64, 1536, 3 << 19
STEPS, TRAIN_BATCH, TRAIN_LENGTH, TRAIN_ROWS, RATE, SEED = 900, 96, 128, 24_000, 0.015, 5
LEAST = 4  # characters of a value of any kind
SYMBOLS = 128  # ASCII; 127 stands for every character beyond


@dataclass
class Model:
    """For each direction the gates' input table (4H, SYMBOLS) and recurrence (4H, H), gates in order i, f, o, g; the
    scores' weights (K, 2H) and bias; transitions from row to column, and scores to begin with."""

    table: list[np.ndarray]
    back: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.table, *self.back, self.out, self.bias, self.trans, self.start]


def blank(hidden: int = HIDDEN, seed: int = SEED) -> Model:
    rng, k = np.random.default_rng(seed), len(KINDS)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    table = [draw(4 * hidden, SYMBOLS, scale=0.3) for _ in range(2)]
    for t in table:
        t[hidden : 2 * hidden] += 1  # remember at first
    return Model(table, [draw(4 * hidden, hidden, scale=hidden**-0.5 * 0.7) for _ in range(2)], draw(k, 2 * hidden, scale=0.2), np.zeros(k, np.float32), draw(k, k, scale=0.05), np.zeros(k, np.float32))


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symbol for each character (not byte) of UTF-8 texts, and the texts' offsets in them."""
    head = (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(head, out=before[1:])
    return np.minimum(data[head], 127), before[off]


# ---------------------------------------------------------------- decoding


def _run(model: Model, ids: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Scores (T, K, B) of windows whose symbols are ids (T, B), by length, longest first: active[t] are longer than t.

    What is kept of a gate is twice its value, of a cell's output too: the recurrence's and the scores' weights are halved
    for it. Beyond its end a window's scores are zero."""
    steps, many = ids.shape
    hidden, k = model.back[0].shape[1], len(model.bias)
    scores = np.zeros((steps, k, many), np.float32)
    space, spare = np.empty(4 * hidden * many, np.float32), np.empty(4 * hidden * many, np.float32)
    for way, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        # each gate apart, window by window: what is taken of the input's table is whole rows
        table = np.ascontiguousarray(model.table[way].reshape(4, hidden, -1).transpose(0, 2, 1))
        back = np.ascontiguousarray((model.back[way] * np.float32(0.5)).reshape(4, hidden, hidden).transpose(0, 2, 1))
        out = np.ascontiguousarray(model.out[:, way * hidden : (way + 1) * hidden]) * np.float32(0.5)
        h, c = np.zeros((many, hidden), np.float32), np.zeros((many, hidden), np.float32)
        for t in order:
            n = int(active[t])
            g, m = space[: 4 * hidden * n].reshape(4, n, hidden), spare[: 4 * hidden * n].reshape(4, n, hidden)
            hn, cn, at = h[:n], c[:n], ids[t, :n].astype(np.intp)
            for gate in range(4):
                np.take(table[gate], at, axis=0, out=g[gate], mode="clip")
                np.matmul(hn, back[gate], out=m[gate])
            g += m
            np.abs(g, out=m)
            m += 1
            g /= m
            g[:3] += 1
            cn *= g[1]
            g[0] *= g[3]
            cn += g[0]
            u = m[0]
            np.abs(cn, out=u)
            u += 2
            np.divide(cn, u, out=hn)
            hn *= g[2]
            cn *= 0.5
            scores[t, :, :n] += out @ hn.T
    for t in range(steps):
        scores[t, :, : active[t]] += model.bias[:, None]
    return scores


def _viterbi(model: Model, scores: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The best tags (T, B) of windows of these lengths; beyond a window's end its tags mean nothing."""
    steps, k, many = scores.shape
    best = np.empty((steps, k, many), np.float32)
    best[0] = scores[0] + model.start[:, None]
    for t in range(1, steps):
        best[t] = (best[t - 1][:, None, :] + model.trans[:, :, None]).max(axis=0) + scores[t]
    tags = np.zeros((steps, many), np.uint8)
    at, last = np.zeros(many, np.int64), length - 1
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            at = (best[t] + model.trans[:, at]).argmax(axis=0)
        ends = last == t
        if ends.any():
            at = np.where(ends, best[t].argmax(axis=0), at)
        tags[t] = at
    return tags


def tag(model: Model, chars: np.ndarray, off: np.ndarray, window: int = WINDOW, margin: int = MARGIN, batch: int = BATCH) -> np.ndarray:
    """A kind for each character of texts (symbols with offsets)."""
    tags = np.zeros(len(chars), np.uint8)
    size, step = np.diff(off), window - 2 * margin
    many = np.where(size > 0, np.maximum(1, -(-(size - 2 * margin) // step)), 0)
    doc = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = off[:-1][doc] + nth * step
    length = np.minimum(window, off[1:][doc] - first)
    own_from = np.where(nth > 0, margin, 0)
    own_to = np.where(nth + 1 < many[doc], window - margin, length)
    order = np.argsort(-length, kind="stable")
    trans = model.trans
    to_none, within = trans[0, 0], np.ones_like(trans, bool)
    within[0, 0] = False
    most = float(max(0, (trans - to_none)[within].max()))  # that a step may gain on staying at none
    begin = float(max(0, (model.start - model.start[0]).max()))
    for a in range(0, len(order), batch):
        own = order[a : a + batch]
        n = length[own]
        longest = int(n[0])
        ids = np.zeros((longest, len(own)), np.uint8)
        for j, (f, m) in enumerate(zip(first[own].tolist(), n.tolist(), strict=True)):
            ids[:m, j] = chars[f : f + m]
        active = np.searchsorted(-n, -np.arange(longest), "left")
        scores = _run(model, ids, active)
        ahead = scores[:, 1:].max(axis=1) - scores[:, 0]
        ahead[np.arange(longest)[:, None] >= n] = -np.inf
        # any path that leaves none costs what it loses at each step less what transitions give: two for the first
        # character of a stay (in and out), one for each further
        open_ = np.flatnonzero((ahead + 2 * most + begin > 0).any(axis=0))
        if len(open_):
            found = _viterbi(model, scores[:, :, open_], n[open_])
            for j, w in enumerate(own[open_].tolist()):
                lo, hi = int(own_from[w]), int(own_to[w])
                tags[first[w] + lo : first[w] + hi] = found[lo:hi, j]
    return tags


def spans_of(tags: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, end, kind) of each run of one kind, start and end counted in the text's characters."""
    if not tags.any():
        return []
    edge = np.zeros(len(tags) + 1, bool)
    edge[1:-1] = tags[1:] != tags[:-1]
    edge[off] = True
    cut = np.flatnonzero(edge)
    lo, hi = cut[:-1], cut[1:]
    on = tags[lo] > 0
    lo, hi = lo[on], hi[on]
    doc = np.searchsorted(off, lo, "right") - 1
    return list(zip(doc.tolist(), (lo - off[doc]).tolist(), (hi - off[doc]).tolist(), tags[lo].tolist(), strict=True))


def reconciled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of a text, with every other occurrence (bounded by no letter or digit) of what they hold; none overlap. Spans
    of fewer than LEAST characters are left out: no value of any kind is as short."""
    out = [(a, b, k) for a, b, k in spans if b - a >= LEAST]
    taken = bytearray(len(text))
    for a, b, _ in out:
        taken[a:b] = b"\1" * (b - a)
    for value, kind in {text[a:b]: k for a, b, k in out}.items():
        at = text.find(value)
        while at >= 0:
            end = at + len(value)
            if not (text[at - 1 : at].isalnum() and value[0].isalnum()) and not (text[end : end + 1].isalnum() and value[-1].isalnum()) and not any(taken[at:end]):
                out.append((at, end, kind))
                taken[at:end] = b"\1" * (end - at)
            at = text.find(value, end)
    return sorted(out)


def redact(docs: DataFrame, model: Model | None = None, hidden_as: str = "<{}>", spans: str | None = "pii_spans") -> DataFrame:
    """The documents with private values masked by their kind, n_chars of changed ones corrected, and a column `spans`.

    It has (start, end, kind) in characters of the text as it was; empty where nothing was found, as for null and empty
    texts, which stay as they are. Spans of fewer than LEAST characters are left out. Whole texts are read, of any length.
    Repeated rows are treated alike; an empty table gives no rows. Other columns of docs stay, but for one of that name;
    with spans None all stay and none is added.
    """
    own = documents_of(docs if spans is None else docs.drop(spans))
    sent = own.sparkSession.sparkContext.broadcast(model or trained(own.sparkSession))
    columns = list(own.columns)
    kind_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def each(batches):
        for batch in batches:
            column = batch.column("text")
            data, off = text_bytes(column)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for i, j in text_chunks(off, CHUNK):
                chars, at = symbols(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for d, a, b, k in spans_of(tag(sent.value, chars, at), at):
                    found.setdefault(i + d, []).append((a, b, k))
            listed: list[list[dict]] = [[] for _ in range(len(column))]
            changed = np.zeros(len(column), bool)
            texts, lengths = [], []
            for d in sorted(found):
                text = column[d].as_py()
                own = reconciled(text, found[d])
                if not own:
                    continue
                parts, at = [], 0
                for a, b, k in own:
                    parts += [text[at:a], hidden_as.format(KINDS[k].upper())]
                    at = b
                changed[d] = True
                texts.append("".join(parts) + text[at:])
                lengths.append(len(texts[-1]))
                listed[d] = [{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in own]
            arrays = {n: batch.column(n) for n in columns}
            if texts:
                mask = pa.array(changed)
                arrays["text"] = pc.replace_with_mask(column, mask, pa.array(texts, column.type))
                arrays["n_chars"] = pc.replace_with_mask(batch.column("n_chars"), mask, pa.array(lengths, pa.int64()))
            more = [] if spans is None else [(spans, pa.array(listed, kind_type))]
            yield pa.RecordBatch.from_arrays([*arrays.values(), *[a for _, a in more]], [*columns, *[n for n, _ in more]])

    return own.mapInArrow(each, own.schema if spans is None else schema_and(own, **{spans: "array<struct<start:bigint,end:bigint,kind:string>>"}))


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with private values masked, as redact() does, in the columns that they have."""
    return redact(docs, model, spans=None)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(read(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- training

_PARTS = "the and ing er on ti st re en ou ha le de que ment eau aux ion sch ung keit der ver los as ci ado mente in of to is a e i o u th wh ly ble ga mi ra ß ä ö ü é è ç ñ í ó ı я но ст 日 本".split()
_HEX, _DIGIT, _CAPS, _ALNUM = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


_ONSET = "b c ch cl cr d dr f fl fr g gl gr h j k kn l ll m n ñ p pf ph pl pr qu r rr s sch sh sk sl sp st str t th tr tz v w wh x y z ß".split() + [""] * 9
_VOWEL = "a e i o u a e i o u a e i o u ai au ea ee ei eu ie io oo ou ue y á à â ä é è ê í ó ö ú ü œ".split()
_CODA = "b c ck d ff ft g k l ll lt m mp n nd ng nn nt p pf r rd rr rt s sch ss st t th tt tz x z ß".split() + [""] * 30


def _word(rnd: random.Random, most: int = 5) -> str:
    if rnd.random() < 0.5:
        return "".join(rnd.choices(_PARTS, k=rnd.randint(1, most)))
    return "".join(rnd.choice(_ONSET) + rnd.choice(_VOWEL) + rnd.choice(_CODA) for _ in range(rnd.randint(1, most)))


def _of(rnd: random.Random, letters: str, least: int, most: int = 0) -> str:
    return "".join(rnd.choices(letters, k=rnd.randint(least, most or least)))


def _shape(rnd: random.Random, shape: str) -> str:
    """The shape with # as a digit, @ as a capital and % as any letter or digit."""
    at = {"#": _DIGIT, "@": _CAPS, "%": _ALNUM}
    return "".join(rnd.choice(at[c]) if c in at else c for c in shape)


PHONES = ("+1 (###) 555-####", "+1 (###) 555-####", "+1 (###) 555-####", "+1 (###) 555-####", "+# (###) ###-####", "(###) ###-####", "###-###-####", "###.###.####", "+1 ### ### ####", "+1##########", "+## ## #### ####", "+## # ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "+## ### #######", "0##/#######", "0##/########", "0## ########", "0### ######", "0#### ######", "+## #### ######", "+## (0)## #######", "### ## ## ##", "+## ### ## ## ##", "+##########", "+###########")
CARDS = ("################", "################", "################", "################", "#### #### #### ####", "####-####-####-####", "3### ###### #####", "5###############", "4### #### #### ####")
IDS = ("@@## #### #### #### #### ##", "@@####################", "@@## @@@@ #### #### #### ##", "@@## #### #### #### #### #### ###", "@@################", "###-##-####", "###-##-####", "@@######@", "@@ ## ## ## @", "########@")
KEYS = ("AKIA@@@@@@@@@@@@@@@@", "ASIA@#@#@@##@@#@@#@@", "AKIA@#@@@##@@#@@@#@@", "ghp_%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "gho_%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "sk_live_%%%%%%%%%%%%%%%%%%%%%%%%", "sk-%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "xoxb-###########-%%%%%%%%%%%%%%%%%%%%%%%%", "AIza%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "glpat-%%%%%%%%%%%%%%%%%%%%")


def _value(rnd: random.Random, kind: str) -> tuple[str, str, str]:
    """(before, value, after): what comes with a value but isn't private itself. The commonest forms come more often."""
    name = lambda: "".join(c for c in _word(rnd) if c not in "日本") or "x"
    x = rnd.random()
    if kind == "email":
        user = f"{name()}.{_of(rnd, _DIGIT, 2)}" if x < 0.4 else f"{name()}{rnd.choice('._-+')}{name()}" if x < 0.75 else f"{name()}{_of(rnd, _DIGIT, 0, 4)}"
        y = rnd.random()
        end = rnd.choice(("com", "com", "org", "net", "io", "de", "fr", "es", "it", "nl", "co.uk", "ac.uk", "com.au", "co.jp", "gov.br", "edu", "info"))
        host = f"mail{_of(rnd, _DIGIT, 1)}.example.com" if y < 0.4 else f"{rnd.choice(('mail', 'post', 'web', 'smtp'))}{_of(rnd, _DIGIT, 0, 1)}.{name()}.{end}" if y < 0.6 else f"{name()}.{name()}.{end}" if y < 0.7 else f"{name()}-{name()}.{end}" if y < 0.75 else f"{name()}.{end}"
        return rnd.choice(("", "", "", "", "mailto:", "<")), f"{user}@{host}", ""
    if kind == "phone":
        return rnd.choice(("", "", "", "", "", "tel:", "Tel. ", "phone: ", "fax ")), _shape(rnd, rnd.choice(PHONES)), ""
    if kind == "card":
        return rnd.choice(("", "", "", "", "card ", "card: ")), _shape(rnd, rnd.choice(CARDS)), ""
    if kind == "ip":
        if x < 0.25:
            parts = [_of(rnd, _HEX, 1, 4) for _ in range(8)]
            if x < 0.15:
                a = rnd.randint(1, 5)
                return "", ":".join(parts[:a]) + "::" + ":".join(parts[rnd.randint(a + 1, 7) :]), ""
            return "", ":".join(parts), ""
        return rnd.choice(("", "", "", "", "ip ", "host ")), ".".join(str(rnd.randint(0, 255)) for _ in range(4)), rnd.choice(("", "", "", "", f":{rnd.randint(80, 9000)}"))
    if kind == "id":
        return rnd.choice(("", "", "", "IBAN ", "SSN ", "id ", "IBAN: ")), _shape(rnd, rnd.choice(IDS)), ""
    label = lambda *names: rnd.choice(names) + rnd.choice((": ", "=", " = ", ' = "', '="'))
    if x < 0.5:
        return rnd.choice(('token = "', 'token = "', 'token = "', "api_key: ", 'secret="', "key=", "")), _of(rnd, _HEX, rnd.choice((40, 40, 40, 32, 64))), ""
    if x < 0.7:
        return rnd.choice(("", "", label("key", "token", "api_key"))), _shape(rnd, rnd.choice(KEYS)), ""
    if x < 0.78:
        return rnd.choice(("", "", "Bearer ", "token: ")), f"eyJ{_of(rnd, _ALNUM + '-_', 15, 30)}.eyJ{_of(rnd, _ALNUM + '-_', 20, 40)}.{_of(rnd, _ALNUM + '-_', 20, 43)}", ""
    if x < 0.86:
        return label("secret", "token", "secret_key", "access_key"), _of(rnd, _ALNUM + "/+", 24, 44) + rnd.choice(("", "", "=", "==")), ""
    word = rnd.choice((lambda: name() + _of(rnd, _DIGIT, 1, 4), lambda: name().capitalize() + _of(rnd, "!#$%&*?", 1, 2) + _of(rnd, _DIGIT, 1, 4), lambda: _of(rnd, _ALNUM + "!#$%&*?", 8, 16), lambda: name().capitalize() + _of(rnd, _DIGIT, 2, 4) + _of(rnd, "!#$%&*?", 1, 1)))()
    return label("password", "password", "Password", "passwd", "pwd", "pass", "Passwort", "passphrase"), word if len(word) >= 6 else word + _of(rnd, _DIGIT, 6), ""


def _harmless(rnd: random.Random) -> str:
    d = lambda a, b=0: _of(rnd, _DIGIT, a, b)
    forms = (
        lambda: d(1, 8), lambda: d(1, 8), lambda: f"{d(1, 3)}.{d(1, 2)}", lambda: f"{d(1)}.{d(1, 2)}.{d(1, 2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"${d(1, 4)}.{d(2)}", lambda: f"{d(1, 2)}%",
        lambda: f"Licensed under CC BY-NC {d(1)}.0.", lambda: f"{rnd.choice(('version', 'v', 'release', 'build', 'Version'))} {d(1, 2)}.{d(1, 2)}.{d(1, 2)}{rnd.choice(('', f'.{d(1, 2)}'))}", lambda: f"version {d(1)}.", lambda: f"@{_word(rnd)}", lambda: f"({d(1, 3)})", lambda: f"https://site{d(1, 3)}.example.com/{_word(rnd)}/{d(1, 5)}",
        lambda: f"{d(1, 3)},{d(3)}", lambda: f"{_word(rnd)}-{d(1, 3)}", lambda: f"token = {_word(rnd)}", lambda: f"#{d(1, 5)}", lambda: f"{rnd.choice(('commit', 'commit', 'revision', 'rev', 'sha', 'merge'))} {_of(rnd, _HEX, rnd.choice((40, 40, 40, 7, 10)))}", lambda: f"{rnd.choice(('sha256', 'sha1', 'md5', 'checksum', 'digest'))}{rnd.choice((':', ' ', ': '))}{_of(rnd, _HEX, rnd.choice((64, 40, 32)))}",
        lambda: f"{d(4)}-{d(4)}", lambda: f"{rnd.choice(('password', 'token', 'key', 'secret', 'email', 'phone', 'card'))} {_word(rnd)}", lambda: f"the {rnd.choice(('password', 'secret', 'key', 'pass'))} is {_word(rnd)}", lambda: f"{d(1, 2)}/{d(1, 2)}/20{d(2)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"{d(1, 3)} {d(3)} {d(3)}", lambda: f"id {d(1, 6)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
    )
    return rnd.choice(forms)()


def examples(n: int, length: int = TRAIN_LENGTH, seed: int = SEED) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Texts of `length` characters and their labelled spans (start, end, kind). Each is the beginning or the end of a
    longer one, cut where no value is."""
    rnd = random.Random(seed)
    texts, labelled = [], []
    while len(texts) < n:
        style, parts, spans, at = rnd.randint(0, 7), [], [], 0
        plain = rnd.random() < 0.3
        while at < length + 40:
            x, kind = rnd.random(), None
            before = after = ""
            if x < (0.0 if plain else 0.15):
                kind = rnd.choice(KINDS[1:])
                before, value, after = _value(rnd, kind)
                after = ('"' if before.endswith('"') else ">" if before == "<" else "") + after
            elif x < (0.1 if plain else 0.27):
                value = _harmless(rnd)
            else:
                value = _word(rnd)
                if rnd.random() < 0.1:
                    value = value.capitalize()
            if style == 1:
                before, value, after = before.upper(), value.upper(), after.upper()
            tail = after
            if style == 1:
                tail += "!!"
            elif style == 2:
                tail += rnd.choice(("###", "$$$", "%%%", "&&&", "***"))
            elif rnd.random() < 0.2:
                tail += rnd.choice((".", ".", ",", ";", ":", ")", "?"))
            gap = " | " if style == 3 else "\n" if rnd.random() < 0.05 else " "
            if kind:
                spans.append((at + len(before), at + len(before) + len(value), kind))
            parts.append(before + value + tail + gap)
            at += len(parts[-1])
        text = "".join(parts)
        if rnd.random() < 0.8:
            text = text.rstrip()
            if rnd.random() < 0.5 and text[-1].isalpha():
                text += "."
        cut = 0 if rnd.random() < 0.5 else len(text) - length
        if any(a < edge < b for a, b, _ in spans for edge in (cut, cut + length)):
            continue
        texts.append(text[cut : cut + length])
        labelled.append([(a - cut, b - cut, k) for a, b, k in spans if a >= cut and b <= cut + length])
    return texts, labelled


def _steps(model: Model, ids: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss for each window and gradients of the arrays, for symbols and tags (T, B), all windows of one length. Both
    directions go at once, the second over the symbols in reverse."""
    steps, many = ids.shape
    hidden, k = model.back[0].shape[1], len(model.bias)
    back = np.stack(model.back)
    both_ways = (ids, ids[::-1])
    gate = np.stack([np.take(t, own, axis=1) for t, own in zip(model.table, both_ways, strict=True)]).transpose(2, 0, 1, 3).copy()
    cell, hid = np.empty((steps, 2, hidden, many), np.float32), np.empty((steps, 2, hidden, many), np.float32)
    h, c = np.zeros((2, hidden, many), np.float32), np.zeros((2, hidden, many), np.float32)
    for t in range(steps):
        g = gate[t]
        g += back @ h
        g /= 1 + np.abs(g)
        s = g[:, : 3 * hidden]
        s *= 0.5
        s += 0.5
        c = np.multiply(g[:, hidden : 2 * hidden], c, out=cell[t])
        c += g[:, :hidden] * g[:, 3 * hidden :]
        h = np.divide(c, 1 + np.abs(c), out=hid[t])
        h *= g[:, 2 * hidden : 3 * hidden]
    both = np.concatenate([hid[:, 0], hid[::-1, 1]], axis=1)
    scores = (model.out @ both + model.bias[:, None]).astype(np.float64)
    trans = model.trans.astype(np.float64)
    # forward and backward sums, scaled at each step to one
    top = scores.max(axis=1)
    odds, move = np.exp(scores - top[:, None]), np.exp(trans)
    alpha, beta, size = np.empty((steps, k, many)), np.ones((steps, k, many)), np.empty((steps, many))
    for t in range(steps):
        a = odds[t] * (move.T @ alpha[t - 1] if t else np.exp(model.start.astype(np.float64))[:, None])
        size[t] = a.sum(axis=0)
        alpha[t] = a / size[t]
    ahead = np.empty((steps, k, many))
    for t in range(steps - 1, 0, -1):
        ahead[t] = odds[t] * beta[t] / size[t]
        beta[t - 1] = move @ ahead[t]
    pair = move * np.einsum("tib,tjb->ij", alpha[:-1], ahead[1:], optimize=True)
    cols, at = np.arange(many), np.arange(steps)[:, None]
    path = scores[at, gold, cols].sum() + model.start[gold[0]].sum() + trans[gold[:-1], gold[1:]].sum()
    loss = float(np.log(size).sum() + top.sum() - path) / many
    d_scores = alpha * beta
    d_scores[at, gold, cols] -= 1
    d_scores = (d_scores / many).astype(np.float32)
    np.add.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    d_out = np.einsum("tkb,thb->kh", d_scores, both, optimize=True)
    d_both = model.out.T @ d_scores
    d_hid = np.stack([d_both[:, :hidden], d_both[::-1, hidden:]], axis=1)
    i, f, o, g = (gate[:, :, x * hidden : (x + 1) * hidden] for x in range(4))
    bent = 1 + np.abs(cell)
    before = np.zeros_like(cell)
    before[1:] = cell[:-1]
    slope = lambda x: 0.5 * (1 - np.abs(2 * x - 1)) ** 2
    by_cell = np.concatenate([slope(i) * g, slope(f) * before], axis=2), (1 - np.abs(g)) ** 2 * i
    by_out, through = slope(o) * cell / bent, o / bent**2
    d_gate, turned = np.empty_like(gate), back.transpose(0, 2, 1).copy()
    dh, dc = np.zeros((2, hidden, many), np.float32), np.zeros((2, hidden, many), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + d_hid[t]
        dc = dc + dh * through[t]
        d = d_gate[t]
        np.multiply(dc, by_cell[0][t, :, :hidden], out=d[:, :hidden])
        np.multiply(dc, by_cell[0][t, :, hidden:], out=d[:, hidden : 2 * hidden])
        np.multiply(dh, by_out[t], out=d[:, 2 * hidden : 3 * hidden])
        np.multiply(dc, by_cell[1][t], out=d[:, 3 * hidden :])
        dh = turned @ d
        dc = dc * f[t]
    tables, backs = [], []
    for way, own in enumerate(both_ways):
        rows = d_gate[:, way].transpose(1, 0, 2).reshape(4 * hidden, -1)
        flat = own.ravel().astype(np.int64)
        tables.append(np.stack([np.bincount(flat, r, SYMBOLS) for r in rows]).astype(np.float32))
        backs.append(np.einsum("tgb,thb->gh", d_gate[1:, way], hid[:-1, way], optimize=True))
    return loss, [*tables, *backs, d_out, d_scores.sum(axis=(0, 2)), (pair / many).astype(np.float32), d_scores[0].sum(axis=1)]


def fit(texts: list[str], spans: list[list[tuple[int, int, str]]], steps: int = STEPS, batch: int = TRAIN_BATCH, rate: float = RATE, hidden: int = HIDDEN, seed: int = SEED) -> Model:
    """A model from texts of one length and their labelled spans, by Adam on the CRF's likelihood."""
    length = len(texts[0])
    ids = np.array([[min(ord(c), 127) for c in t] for t in texts], np.uint8).T
    gold = np.zeros((length, len(texts)), np.int64)
    for j, own in enumerate(spans):
        for a, b, kind in own:
            gold[a:b, j] = KINDS.index(kind)
    model, rng = blank(hidden, seed), np.random.default_rng(seed)
    arrays = model.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(texts), batch)
        _, grads = _steps(model, ids[:, at], gold[:, at])
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        pace = rate * min(1.0, step / 20) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / steps)))
        for a, g, m, v in zip(arrays, grads, first, second, strict=True):
            g = g * min(1.0, 5 / max(norm, 1e-9))
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            a -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


@lru_cache(maxsize=1)
def fitted() -> Model:
    """The model of the standard settings; made once in a process, the same each time."""
    return fit(*examples(TRAIN_ROWS))


def trained(spark: SparkSession) -> Model:
    """The model of the standard settings, from the shared folder if any session has put it there, else fitted and put
    there. Its name follows from the settings and this module's text, so another version doesn't take it for its own."""
    where = f"{shared_dir(spark).rstrip('/')}/tidemark-pii-{hashlib.md5(Path(__file__).read_bytes()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        made = [(k, list(a.shape), a.astype(np.float32).tobytes()) for k, a in enumerate(fitted().arrays())]
        spark.createDataFrame(made, "k int, shape array<int>, raw binary").coalesce(1).write.mode("overwrite").parquet(where)
    rows = sorted(spark.read.parquet(where).collect())
    arrays = [np.frombuffer(r["raw"], np.float32).reshape(r["shape"]).copy() for r in rows]
    return Model(arrays[:2], arrays[2:4], *arrays[4:])
