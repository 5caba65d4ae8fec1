"""Speech transcripts as clean, ordered speaker turns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fillers, titles, roles, numbered-speaker words and head-line words of transcripts.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "m", "mme", "mlle", "sr", "sra", "srta", "señor", "señora", "don", "doña", "monsieur", "madame"}
ROLES = {
    "chairperson": ("chairperson", "chairman", "chairwoman", "chair", "chp"),
    "interviewer": ("interviewer", "int", "intv"),
    "moderator": ("moderator", "mod"),
    "respondent": ("respondent", "resp"),
    "secretary": ("secretary", "sec", "secr"),
    "host": ("host",),
    "guest": ("guest",),
    "operator": ("operator", "op"),
    "interviewee": ("interviewee",),
    "facilitator": ("facilitator", "fac"),
    "narrator": ("narrator",),
}
NUMBERED = "speaker|spkr|spk|sp|s|sprecher|sprecherin|locuteur|intervenant|hablante|orador|interlocutor"
HEADS = {"date", "participants", "participant", "subject", "title", "note", "notes", "time", "owner", "location", "place", "duration", "present", "attendees", "agenda", "topic", "recording", "file", "language", "from", "to", "cc", "datum", "teilnehmer", "fecha", "participantes", "asistentes", "lieu", "ort", "lugar", "objet", "betreff", "asunto", "kind", "style", "region"}

_FILLER = re.compile(r"(?<!\w)(?:you know|i mean|tu vois|o sea|uh|um|er|erm|uhm|hm+|mm+|mhm|ah|oh|like|äh|ähm|öh|halt|also|sozusagen|euh|bah|hein|ben|enfin|eh|ehm|este|pues)(?!\w)", re.I)
_SOUND = re.compile(r"\[[^\[\]\n]*\]|\([^()\n]*\)|\{[^{}\n]*\}|<[^<>\n]*>|\*[^*\n]+\*|♪[^♪\n]*♪|♪")
_SPOKEN_FILLER = re.compile(r"(?<!\w)(?:—\s*)?(?:you know|i mean|tu vois|o sea|uh|um|er|erm|uhm|hm+|mm+|mhm|äh|ähm|öh|euh|bah|hein|ehm|eh)(?!\w)(?:,|\.\.\.|…|\s*—)?", re.I)
_T = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?|\d+(?:[.,]\d+)?\s?s(?:ec)?"
_CUE = re.compile(rf"^\s*({_T})\s*-->\s*({_T})")
_ALONE = re.compile(rf"^[\[(]?({_T})[\])]?$")
_VOICE = re.compile(r"^<v(?:\.[^\s>]*)?\s+([^>]+)>(.*)$")
_LINE = re.compile(rf"^(?P<mark>>>\s*)?(?:[\[(](?P<t1>{_T})[\])]\s*)?(?P<mark2>>>\s*)?(?P<label>[^\s:<>\[({{*♪•–—-][^:<>\n]{{0,58}}?)\s*(?:[\[(](?P<t2>{_T})[\])])?\s*(?P<sep>:| [–—-])(?:\s+(?P<text>.*))?$")
_BARE = re.compile(rf"^[\[(](?P<t>{_T})[\])]\s*(?P<text>.*)$")
_NUMBER = re.compile(rf"^(?:{NUMBERED})[\s._#-]*0*(\d{{1,3}})$")
_REMARK = re.compile(r"\s*[\[({][^\])}]*[\])}]")
_NAME_TOKEN = re.compile(r"^[^\W\d_][^\W\d_'’]*(?:[-'’][^\W\d_]+)*\.?$")
_PARTICLE = {"van", "von", "de", "del", "la", "le", "der", "den", "di", "da", "du", "al", "el", "zu", "zur"}
_WORD = re.compile(r"[^\W_]+")
_PARTICIPANTS = re.compile(r"^(?:participants?|attendees|present|teilnehmer|participantes|asistentes)\s*:\s*(.+)$", re.I)

#: Texts that can't hold a transcript are left out before any Python runs.
MAYBE = (
    r"(?mU)(-->|[\[(]\d[\d:.,]*\s?s?(ec)?[\])]\s*(:|[–—-])|^\s*>>|^\s*<v[.\s]|^\s*[\[(]?\d[\d:.,]*\s?s?(ec)?[\])]\s*\S|^\s*((\d{1,3}:)?\d{1,2}:\d{2}([.,]\d{1,3})?|\d+([.,]\d+)?\s?s(ec)?)\s*$"
    r"|^[^\S\n]*[^\n:]{1,60}?(:| [–—-])(\s|$))"  # what _LINE takes for a label, alone on its line or before any white space
)


#: Lines of a transcript that the model is fitted on, at most.  Any number is divided.
SAMPLE_LINES = 300


def seconds(mark: str) -> float:
    """Seconds of a time mark such as 00:01:02.5, 01:02 or 62.5s."""
    mark = mark.strip().rstrip("sec ").replace(",", ".")
    total = 0.0
    for part in mark.split(":"):
        total = total * 60 + float(part or 0)
    return total


def spoken(text: str) -> bool:
    """Whether anything but fillers and sound notes was said."""
    return bool(_WORD.search(_FILLER.sub(" ", _SOUND.sub(" ", text))))


def cleaned(text: str) -> str:
    """The text without sound notes, unambiguous fillers and repeated words."""
    text = _SPOKEN_FILLER.sub(" ", _SOUND.sub(" ", text))
    text = re.sub(r"\b(\w+)(\s+\1\b)+", r"\1", text)
    text = re.sub(r"(?:—\s*)+—|\s—\s(?=[.,;?!]|$)", " ", text)
    return re.sub(r"\s+([.,;:?!])", r"\1", re.sub(r"\s+", " ", text)).strip()


@dataclass
class Line:
    text: str
    label: str | None = None
    time: float | None = None
    shape: int = 0  # 0 no label, 1 any words, 2 name-like, 3 numbered speaker, role or voice mark
    head: bool = False
    parts: frozenset = field(default_factory=frozenset)
    bare: int = 0  # the shape without regard to marks
    marked: bool = False  # a time, a speaker mark or a cue stands with the label
    raw: str = ""  # the whole line, for one that is no label after all

    def said(self) -> str:
        """What is said in the line if it goes on with a turn."""
        return self.raw if self.label and self.raw else self.text


def _stripped(label: str) -> str:
    label = _REMARK.sub("", label).strip(" \t.-–—")
    tokens = label.split()
    while len(tokens) > 1 and tokens[0].rstrip(".").lower() in TITLES and not (len(tokens[0].rstrip(".")) == 1 and len(tokens) == 2):
        tokens = tokens[1:]
    return " ".join(tokens)


def _shape(label: str) -> int:
    low = _stripped(label).lower()
    if _NUMBER.match(low) or any(low.rstrip(".") in names for names in ROLES.values()):
        return 3
    head = low.split(",")[0].strip()
    if head.rstrip(":") in HEADS:
        return 0
    tokens = _stripped(label).replace(",", " ").split()
    if 1 <= len(tokens) <= 5 and all(_NAME_TOKEN.match(t) for t in tokens):
        cased = [t for t in tokens if t.lower() not in _PARTICLE]
        if all(t[0].isupper() for t in cased) or len(tokens) == 2:
            return 2
    return 1


def parse(text: str) -> list[Line]:
    """The lines that carry content, with the label and time each may have."""
    raw = [x.strip() for x in text.replace("\r\n", "\n").replace("﻿", "").split("\n")]
    out: list[Line] = []
    pending: float | None = None
    dashed = [bool(m and m["sep"] == " –" and _shape(m["label"]) >= 2) for x in raw if x and (m := _LINE.match(x)) is not None or x]
    by_dash = sum(dashed) >= 2 and 2 * sum(dashed) >= len(dashed)
    i = 0
    while i < len(raw):
        s = raw[i]
        nxt = raw[i + 1] if i + 1 < len(raw) else ""
        if not s or s == "WEBVTT" or (s.isdigit() and _CUE.match(nxt)):
            i += 1
            continue
        if m := _CUE.match(s):
            pending = seconds(m[1])
            i += 1
            continue
        if m := _VOICE.match(s):
            out.append(Line(m[2].replace("</v>", ""), m[1].strip(), pending, 3, bare=_shape(m[1].strip()), marked=True))
            pending = None
            i += 1
            continue
        if (m := _ALONE.match(nxt)) and len(s) <= 60 and _shape(s) >= 2:
            out.append(Line("", s, seconds(m[1]), 3, bare=_shape(s), marked=True))
            i += 2
            continue
        m = _LINE.match(s)
        shape = _shape(m["label"]) if m else 0
        if m and m["sep"] != ":" and not (by_dash and shape == 2) and not (shape == 3 or (shape == 2 and (m["t1"] or m["t2"] or m["mark"] or m["mark2"]))):
            m = None
        if m:
            t = m["t1"] or m["t2"]
            when = seconds(t) if t else pending
            marked = bool(t or m["mark"] or m["mark2"] or pending is not None)
            head = not shape
            out.append(Line(m["text"] or "", m["label"].strip(), when, 3 if marked and shape >= 2 else shape, head, bare=shape, marked=marked, raw=s))
            pending = None
        elif (m := _BARE.match(s)) and not _ALONE.match(s):
            out.append(Line(m["text"], None, seconds(m["t"])))
        else:
            out.append(Line(s.replace("</v>", ""), None, pending))
            pending = None
        i += 1
    for x in out:
        x.parts = frozenset(_WORD.findall(x.text.lower()))
    return out


@dataclass(frozen=True)
class Model:
    """Weights of a semi-Markov conditional model that divides lines into whole turns and single lines outside any.

    A turn is scored by its first line (label, marks, pause, how the line before ends,
    shared words), by each further line of it, and by its length; a line outside by what
    it has of a label and where it stands.  The chance of a division is its exponentiated
    score over that of all divisions.  Without training the weights are as below.
    """

    start: tuple[float, ...] = (-1.0, -3.0, -0.5, 3.0, 4.0, 2.0, 3.0, 0.5, 1.0, 0.3, 0.2, -0.5, -6.0)
    inside: tuple[float, ...] = (0.5, 1.0, 0.5, -3.0, -4.0, -2.0, -3.0, -0.5, -1.0, 0.0, 0.5, -6.0)
    rest: tuple[float, ...] = (-1.0, 2.5, 5.0, -2.0, -3.0, -1.0, -4.0, -0.5)
    length: tuple[float, ...] = (0.0, 0.0, 0.0)

    def flat(self) -> np.ndarray:
        return np.array([*self.start, *self.inside, *self.rest, *self.length])

    @staticmethod
    def of(w: np.ndarray) -> "Model":
        ends = np.cumsum([len(Model.start), len(Model.inside), len(Model.rest)])
        return Model(*(tuple(float(x) for x in part) for part in np.split(w, ends)))


def features(lines: list[Line]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line what it says for the beginning of a turn, for going on with one, and for standing outside."""
    n = len(lines)
    often = Counter(_stripped(x.label).lower() for x in lines if x.label)
    first = next((i for i, x in enumerate(lines) if x.bare >= 2 or x.marked), n)
    begin, on, out = [], [], []
    before: float | None = None
    for i, x in enumerate(lines):
        last = lines[i - 1] if i else None
        near = frozenset().union(*(y.parts for y in lines[max(0, i - 3) : i]))
        close = len(x.parts & last.parts) / max(1, min(len(x.parts), len(last.parts))) if last else 0.0
        shared = len(x.parts & near) / max(1, min(len(x.parts), len(near)))
        gap = min(30.0, max(0.0, x.time - before)) / 30 if x.time is not None and before is not None else 0.0
        before = x.time if x.time is not None else before
        end = last.text.rstrip()[-1:] if last else ""
        label = [float(x.label is None), float(x.bare == 1), float(x.bare == 2), float(x.bare == 3), float(bool(x.label) and often[_stripped(x.label).lower()] > 1), float(x.marked), float(x.time is not None), gap, float(end in ".?!…")]
        spoke = i > first
        begin.append([1.0, *label, float(end == "?"), close, float(x.head)])
        on.append([1.0, *label, shared, float(x.head)])
        out.append([1.0, float(not spoke), float(x.head), float(x.label is None and spoke), float(x.bare >= 2), float(x.bare >= 2 and spoke), float(x.marked), float(x.time is not None)])
    return np.array(begin).reshape(n, -1), np.array(on).reshape(n, -1), np.array(out).reshape(n, -1)


def segment(lines: list[Line], model: Model) -> list[tuple[int, int, bool]]:
    """The most likely division of the lines into (start, end, is a turn), by dynamic programming.

    A state is outside, or the number of lines of the turn so far, of which all from the
    fourth on count alike; so turns of any length are looked at, in time linear in the lines.
    """
    if not lines:
        return []
    begin, on, out = (f @ np.array(w) for f, w in zip(features(lines), (model.start, model.inside, model.rest)))
    one, two, more = model.length
    best = [0.0, *[float("-inf")] * 4]
    back: list[tuple[int, ...]] = []
    for a, u, r in zip(begin.tolist(), on.tolist(), out.tolist()):
        top = max(range(5), key=best.__getitem__)
        long = 3 if best[3] >= best[4] else 4
        back.append((top, top, 1, 2, long))
        best = [best[top] + r, best[top] + a, best[1] + u + one, best[2] + u + two, best[long] + u + more]
    state = max(range(5), key=best.__getitem__)
    found, end = [], len(lines)
    for i in range(len(lines) - 1, -1, -1):
        if state < 2:
            found.append((i, end, state == 1))
            end = i
        state = back[i][state]
    return found[::-1]


def weak_labels(lines: list[Line]) -> list[tuple[int, int, bool]]:
    """The division that the marks alone give: a turn begins at a good label and ends before the next one."""
    out: list[tuple[int, int, bool]] = []
    for i, x in enumerate(lines):
        if x.shape >= 2:
            out.append((i, i + 1, True))
        elif out and out[-1][2] and not x.head:
            out[-1] = (out[-1][0], i + 1, True)
        else:
            out.append((i, i + 1, False))
    return out


def hidden(lines: list[Line], rng: Random) -> list[Line]:
    """The lines as a worse transcript would have them: times, speaker marks or the looks of labels are missing, on all or on part of the lines."""
    times, marks, looks, labels = rng.choice([(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0), (0.3, 0.3, 0.0, 0.0), (0.5, 0.5, 0.3, 0.0), (1.0, 1.0, 0.3, 0.0), (0.2, 0.2, 0.2, 0.15)])
    out = []
    for x in lines:
        y = replace(x)
        if rng.random() < times:
            y.time = None
        if rng.random() < marks:
            y.marked, y.shape = False, y.bare
        if y.bare >= 2 and rng.random() < looks:
            y.bare = y.shape = 1
            y.marked = False
        if y.label and rng.random() < labels:
            y.label, y.bare, y.shape, y.marked, y.text = None, 0, 0, False, y.text or y.raw
        out.append(y)
    return out


def _padded(data: list[tuple[list[Line], list[tuple[int, int, bool]]]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features of all texts with zeros after their ends, which lines are there, and the state of each line."""
    longest = max(len(lines) for lines, _ in data)
    parts = [np.zeros((len(data), longest, n)) for n in (len(Model.start), len(Model.inside), len(Model.rest))]
    there, state = np.zeros((len(data), longest)), np.zeros((len(data), longest), int)
    for k, (lines, gold) in enumerate(data):
        there[k, : len(lines)] = 1
        for part, f in zip(parts, features(lines)):
            part[k, : len(lines)] = f
        for i, j, turn in gold:
            for q in range(i, j):
                state[k, q] = min(4, 1 + q - i) if turn else 0
    return parts, there, state


def _likelihood(w: np.ndarray, parts: list[np.ndarray], there: np.ndarray, state: np.ndarray) -> tuple[float, np.ndarray]:
    """The log-likelihood of the divisions, and its gradient, by forward and backward sums over all divisions."""
    m = Model.of(w)
    begin, on, out = (f @ np.array(x) for f, x in zip(parts, (m.start, m.inside, m.rest)))
    texts, n = there.shape
    score = np.stack([out, begin, *(on + d for d in m.length)], 2)  # (text, line, state)
    low = -1e9
    forward, backward = np.full((n + 1, texts, 5), low), np.zeros((n + 1, texts, 5))
    forward[0, :, 0] = 0.0
    for t in range(n):
        f = forward[t]
        every = np.logaddexp.reduce(f, axis=1)
        now = score[:, t] + np.stack([every, every, f[:, 1], f[:, 2], np.logaddexp(f[:, 3], f[:, 4])], 1)
        forward[t + 1] = np.where(there[:, t, None] > 0, np.maximum(now, low), f)
    for t in range(n - 1, -1, -1):
        g = backward[t + 1] + score[:, t]
        free = np.logaddexp(g[:, 0], g[:, 1])
        now = np.stack([free, np.logaddexp(free, g[:, 2]), np.logaddexp(free, g[:, 3]), np.logaddexp(free, g[:, 4]), np.logaddexp(free, g[:, 4])], 1)
        backward[t] = np.where(there[:, t, None] > 0, now, backward[t + 1])
    total = np.logaddexp.reduce(forward[n], axis=1)
    chance = np.exp(np.minimum(forward[1:].transpose(1, 0, 2) + backward[1:].transpose(1, 0, 2) - total[:, None, None], 0)) * there[:, :, None]
    gold = np.eye(5)[state] * there[:, :, None]
    rest = gold - chance
    sides = [rest[:, :, 1], rest[:, :, 2:].sum(2), rest[:, :, 0]]
    gradient = np.concatenate([*(np.einsum("ktf,kt->f", f, r) for f, r in zip(parts, sides)), rest[:, :, 2:].sum((0, 1))])
    return float((score * gold).sum() - total.sum()), gradient


def train(texts: list[str], rounds: int = 60, start: Model = Model(), seed: int = 7) -> Model:
    """The weights of greatest penalised likelihood on transcripts whose marks are complete, with part of the marks hidden.

    What the complete marks say is what the model has to find from the rest, so it learns
    how much recurring labels, pauses, line ends and shared words are worth.  Every second
    text is held out; `start` stays if it makes their divisions more likely.
    """
    every = [(lines, weak_labels(lines)) for lines in map(parse, texts) if len(lines) <= SAMPLE_LINES]
    every = [x for x in every if sum(t for _, _, t in x[1]) >= 2]
    rng = Random(seed)
    views = [[(hidden(lines, rng), gold) for lines, gold in half for _ in range(2)] + half for half in (every[::2], every[1::2])]
    if not all(views):
        return start
    data, held = map(_padded, views)
    prior, w = start.flat(), start.flat()
    step, sign, best, top = np.full(len(w), 0.1), np.zeros(len(w)), w, float("-inf")
    for _ in range(rounds):  # steps by the sign of the gradient
        value, g = _likelihood(w, *data)
        value, g = value - 0.5 * ((w - prior) ** 2).sum(), g - (w - prior)
        if value > top:
            best, top = w, value
        turned = np.sign(g) * sign
        step = np.clip(np.where(turned > 0, step * 1.2, np.where(turned < 0, step * 0.5, step)), 1e-4, 0.5)
        sign = np.where(turned < 0, 0.0, np.sign(g))
        w = w + sign * step
    return Model.of(best) if _likelihood(best, *held)[0] > _likelihood(prior, *held)[0] else start


def speaker_names(labels: list[str], present: list[str] = ()) -> dict[str, str]:
    """For each label the fullest name of its person or role among the labels (then among those `present`)."""
    forms: dict[str, tuple] = {}
    for label in [*labels, *present]:
        s = _stripped(label)
        low = s.lower()
        if m := _NUMBER.match(low):
            forms[label] = ("number", f"speaker {int(m[1])}")
            continue
        bare = low.rstrip(".")
        if role := next((r for r, names in ROLES.items() if bare in names), None):
            forms[label] = ("role", role, bare)
            continue
        if "," in low:
            a, b = (x.strip() for x in low.split(",", 1))
            family_first = len(a.split()) == 1 and len(_stripped(label).split(",")[1].split()) == 1 and not re.fullmatch(r"[A-Z]{2,3}|[a-z]{2}", s.split(",", 1)[1].strip())
            low = f"{b} {a}" if family_first else a
        forms[label] = ("name", tuple(low.split()))
    whole = list(dict.fromkeys(f[1] for f in forms.values() if f[0] == "name" and len(f[1]) > 1 and not f[1][0].endswith(".") and len(f[1][0]) > 1))
    out = {}
    for label in labels:
        f = forms[label]
        if f[0] == "number":
            out[label] = f[1]
        elif f[0] == "role":
            out[label] = max((g[2] for g in forms.values() if g[0] == "role" and g[1] == f[1]), key=len)
        else:
            t = f[1]
            fits: list[tuple] = []
            if t in whole:
                fits = [t]
            elif len(t) > 1:
                fits = [w for w in whole if w[-1] == t[-1] and w[0].startswith(t[0].rstrip("."))] or [w for w in whole if w[0] == t[0] and w[-1].startswith(t[-1].rstrip("."))]
                if not fits and len(t) == 2 and (t[1], t[0]) in whole:
                    fits = [(t[1], t[0])]
                if not fits and t[0].rstrip(".") in TITLES:
                    fits = [w for w in whole if w[-1] == t[-1]]
            elif t:
                one = t[0].rstrip(".")
                fits = [w for w in whole if one in (w[0], w[-1], " ".join(w[1:]))]
                fits = fits or [w for w in whole if one in w]
            out[label] = " ".join(fits[0] if fits else t)
    return out


def turns(text: str | None, model: Model = Model()) -> list[tuple[int, str, float | None, str]]:
    """(turn number, speaker, start in seconds or None, clean text) of a transcript; none of any other text.

    Utterances without a word besides fillers and sound notes are dropped first, then
    neighbouring ones of a speaker are joined.  They are in time order if every one has a
    time mark (equal times: as written), else as written.
    """
    if not text:
        return []
    lines = parse(text)
    good = [x for x in lines if x.shape >= 2]
    strong = [x for x in good if x.shape == 3]
    names = Counter(_stripped(x.label).lower() for x in good)
    if len(good) < 2 or not (len(strong) >= 2 or (max(names.values()) > 1 and any(len(n.split()) > 1 for n in names)) or sum(len(n.split()) == 2 for n in names) >= 2):
        return []
    found = []
    for i, j, is_turn in segment(lines, model):
        if is_turn and lines[i].label and not lines[i].head:
            found.append((lines[i].label, lines[i].time, " ".join(x for x in (lines[i].text, *(y.said() for y in lines[i + 1 : j])) if x)))
        elif is_turn and found:
            label, time, said = found[-1]
            found[-1] = (label, time, f"{said} " + " ".join(x.said() for x in lines[i:j]))
    if len(found) < 2:
        return []
    present = [p.strip() for x in text.splitlines() if (m := _PARTICIPANTS.match(x.strip())) for p in m[1].split(",")]
    who = speaker_names([f[0] for f in found], present)
    if all(f[1] is not None for f in found):
        found.sort(key=lambda f: f[1])
    out: list[list] = []
    for label, time, said in found:
        if not spoken(said):
            continue
        if out and out[-1][0] == who[label]:
            out[-1][2] += " " + cleaned(said)
        else:
            out.append([who[label], time, cleaned(said)])
    return [(i, name, time, said) for i, (name, time, said) in enumerate(out, 1)]


#: Transcripts that the model is fitted on, at most; those with the smallest hash of the key, and of at most so many characters.
SAMPLE, SAMPLE_CHARS = 200, 20_000


def fitted(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Model:
    """A model trained on a bounded sample of the table's transcripts with complete marks."""
    marked = df.where(F.col(text).rlike(r"(?m)^(<v |>>|\[\d|\d+:\d\d|[^\n:]{2,40}\(\d)") & (F.char_length(text) < SAMPLE_CHARS))
    chosen = [r[0] for r in marked.select(key, F.xxhash64(key).alias("h")).distinct().orderBy("h", key).limit(sample).select(key).collect()]
    texts = marked.where(F.col(key).isin(chosen)).select(key, text).dropDuplicates([key]) if chosen else marked.limit(0).select(key, text)
    return train([r[1] for r in sorted(texts.collect())])


def speaker_turns(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """`key`, `turn_no`, `speaker`, `start_s`, `said` of every transcript in the table.

    Null and empty texts and texts that are no transcript give no rows; repeated rows
    give repeated turns; an empty table gives none.  Each text is read by itself, whole.
    """
    model = model or fitted(df, key, text)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *t) for k, x in zip(b.iloc[:, 0], b.iloc[:, 1]) for t in turns(x, model)]
            yield pd.DataFrame(rows, columns=["key", "turn_no", "speaker", "start_s", "said"]).astype({"turn_no": "int32", "start_s": "float64"})

    maybe = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(MAYBE))
    return maybe.mapInPandas(run, f"key {kind}, turn_no int, speaker string, start_s double, said string").withColumnRenamed("key", key)
