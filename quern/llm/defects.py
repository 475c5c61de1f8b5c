"""Broken prompt and response pairs.

A linear classifier with one output a defect, over hashed word n-grams of the whole answer and features of the pair. It is trained on answers
that are broken on purpose: cut off, replaced by (parts of) their prompts, swapped for answers in another language, replaced by refusals
(also after a long preamble) and by fillers; the answers as they are count as good. As some of those are broken already, training is done twice, the second time
without the good examples that the first model doubts. Thresholds are calibrated on examples held back. Languages are told apart by a
linear model over hashed character n-grams, trained on the labelled texts of the corpus.

Both models are fitted on bounded samples (``SAMPLE``, ``LANGUAGE_SAMPLE`` rows, those with the least hashes of their ids); they are applied
to every row.

Defined results: a null answer is empty; without a prompt (null, or no task) an answer is neither a copy nor in a wrong language; a row has at
most one defect, the most certain one; repeated rows are judged alike; rows without id are judged too; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.runtime import table

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
LANGUAGES = ("en", "de", "fr", "es")
SAMPLE, LANGUAGE_SAMPLE, BUCKETS = 5000, 1500, 2**15
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CODE = re.compile(r"\b[A-Z]{1,3}-?\d+\b")
_CITED = re.compile(r"(?:\s*(?:\[[\d,;\s–-]*\]|\([^()]{1,40}\)))+\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+\S")
_WHOLE_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+[^:]+:\s*[\d.,]+\s+[^\W\d_]+\s*$")
_ASKED = [
    (re.compile(r"\b(?:english|englisch\w*|anglais\w*|ingl[eé]s\w*)\b"), 0),
    (re.compile(r"\b(?:german|deutsch\w*|allemand\w*|alem[aá]n\w*)\b"), 1),
    (re.compile(r"\b(?:french|franz[oö]sisch\w*|fran[cç]ais\w*|franc[eé]s\w*)\b"), 2),
    (re.compile(r"\b(?:spanish|spanisch\w*|espagnol\w*|español\w*)\b"), 3),
]
_ASKING = re.compile(r"\b(?:answer\w*|reply|replies|respond\w*|response|write|translat\w*|antwort\w*|schreib\w*|übersetz\w*|répon\w*|traduis\w*|écri\w*|respond\w*|respuesta|traduc\w*|escrib\w*)\b")
#: So many words begin an answer; n-grams behind them are features of their own, numbered from BUCKETS on.
HEAD = 40
#: What a good example counts for when thresholds are set.
GOOD_WEIGHT = 10.0
#: Words the sample of texts holds at least so often tell languages apart.
USUAL = 8
#: Good examples that a first model gives more than this are left out of the second training.
DOUBT = -2.0
#: Stand-ins for an answer and labels before one.
FILLERS = ["none", "null", "nil", "n a", "na", "nan", "empty", "blank", "no answer", "unknown", "tbd", "todo", "undefined", "missing", "placeholder", "no response", "leer", "keine antwort", "vide", "sans réponse", "pas de réponse", "vacío", "sin respuesta", "not available"]
LABELS = ["a", "answer", "antwort", "réponse", "respuesta", "response", "output", "result", "assistant", "final answer", "ergebnis", "résultat", "resultado"]
#: Refusals: openings, bodies, grounds and closings by language, from which examples are put together.
REFUSALS = {
    "en": (
        ["", "", "", "Sorry, ", "I'm sorry, but ", "Apologies, ", "Regrettably, ", "Unfortunately, ", "With respect, ", "Hmm, ", "Thanks, but ", "I'm afraid ", "Hello! ", "Thanks for asking. ", "Thank you for the question! ", "Answer: "],
        "I can't help with that|I cannot assist with this request|I cannot share that|I am unable to answer this question|As a language model, I am unable to answer|I must decline to answer|I have to decline this|I won't answer that|I will not do that|I won't go into that|I'd rather not answer|I'd prefer not to respond|I have to pass on this|I am not permitted to reply here|I am not allowed to discuss this|I don't feel able to take this on|I need to stop here and not answer|no answer can be given by me|this is a question I must leave unanswered|helping with this is beyond my remit|it falls outside what I am allowed to do|you will have to ask somebody else|request refused|I can't do that|I'm not comfortable answering|answering would not be appropriate|it would be unsafe for me to answer|I do not have the ability to open {w}, so I can't answer|my guidelines prevent me from discussing this|I am not able to comply with the request|I won't be able to provide an answer to that|I can't answer this one|I apologise for the inconvenience; answering would not be appropriate|I apologise, but I cannot continue|I refuse to answer".split("|"),
        ["", "", "", " because it concerns {n}", " since I lack access to {n}", "; the rules on {w} forbid it", " – my instructions exclude {w}", ", as it might expose {w}", " without a release from {n}", ", since the request touches on {w} policy", " about {n}", ", even for code {c}", ", so I'd rather not", ", so I have to decline"],
        ["", "", "", " Feel free to ask another question.", " Is there anything else you would like to know?", " Please consult the owner.", " You may ask about something else instead.", " Please ask a person in charge."],
    ),
    "de": (
        ["", "", "Leider ", "Verzeihung, ", "Tut mir leid, ", "Entschuldigung, ", "Bedauerlicherweise ", "Als Sprachmodell "],
        "kann ich das nicht beantworten|kann ich dabei nicht helfen|muss ich passen|hier muss ich passen|darf ich keine Auskunft geben|diese Frage darf ich nicht beantworten|bin ich dazu nicht in der Lage|hier bleibt mir nur, abzulehnen|möchte ich dazu nichts sagen|muss ich die Antwort verweigern|lehne ich die Anfrage ab|ich darf darauf nicht antworten|ich kann diese Bitte nicht erfüllen|das ist mir nicht gestattet".split("|"),
        ["", "", ", weil es um {n} geht", "; die Regeln zu {w} lassen es nicht zu", ", da mir der Zugriff auf {n} fehlt", ", denn meine Vorgaben schließen {w} aus", ", daher lehne ich ab"],
        ["", "", " Bitte fragen Sie die zuständige Stelle.", " Stellen Sie gern eine andere Frage."],
    ),
    "fr": (
        ["", "", "Désolé, ", "Pardon, ", "Malheureusement, ", "Je regrette, mais ", "En tant que modèle de langage, "],
        "je ne peux pas répondre à cette demande|je ne peux pas vous aider|je préfère ne pas répondre|je préfère m'abstenir|je dois refuser|je dois m'abstenir de répondre|il m'est interdit d'en parler|je ne suis pas autorisé à répondre|cette question doit rester sans réponse|je ne suis pas en mesure de répondre|je refuse de répondre|ma réponse est impossible ici".split("|"),
        ["", "", " ; les règles sur les {w} l'excluent", ", car cela concerne {n}", " au sujet de {n}", ", faute d'accès à {n}", ", je préfère donc m'abstenir"],
        ["", "", " Veuillez consulter le responsable.", " Posez-moi une autre question."],
    ),
    "es": (
        ["", "", "Lo siento, ", "Perdón, ", "Por desgracia, ", "Lamentablemente, ", "Como modelo de lenguaje, "],
        "no puedo responder a esa solicitud|no puedo ayudar con eso|debo dejarlo sin respuesta|prefiero abstenerme|prefiero no contestar|debo negarme|no me permiten hablar de ello|no estoy autorizado a responder a esta solicitud|no me es posible contestar|tengo que rechazar la petición|me niego a responder|no se me permite tratar este asunto".split("|"),
        ["", "", "; las reglas sobre {w} lo excluyen", ", porque afecta a {n}", " sobre {n}", ", por falta de acceso a {n}", ", así que prefiero no hacerlo"],
        ["", "", " Consulte a la persona responsable.", " Puede hacer otra pregunta."],
    ),
}


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode()) & (BUCKETS - 1)


# ---- languages


def _grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [_bucket("w" + w), *(_bucket(w[i : i + n]) for n in (2, 3, 4) for i in range(len(w) - n + 1))]


class Languages:
    """A linear model over hashed character n-grams of words; the scores of usual words add up, names and numbers tell nothing."""

    def __init__(self, weights: np.ndarray, usual: set[str]) -> None:
        self.weights, self.usual, self.known = weights, usual, {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "usual": self.usual, "known": {}}

    def word(self, w: str) -> tuple[float, ...]:
        if (got := self.known.get(w)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[w] = tuple((self.weights[_grams(w)].mean(axis=0)).tolist()) if w in self.usual else (0.0,) * len(LANGUAGES)
        return got

    def scores(self, words: list[str]) -> list[float]:
        out = [0.0] * len(LANGUAGES)
        for w in words:
            for k, v in enumerate(self.word(w)):
                out[k] += v
        return out

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], rounds: int = 4) -> "Languages":
        rng, weights = np.random.default_rng(3), np.zeros((BUCKETS, len(LANGUAGES)), np.float64)
        squares = np.full((BUCKETS, len(LANGUAGES)), 1e-3)
        parts = []
        cache: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for text, lang in zip(texts, langs):
            words = [w.lower() for w in _WORD.findall(text)]
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            # up to ten windows, spread over the whole text
            for at in np.unique(np.linspace(0, max(len(words) - 12, 0), min(10, -(-len(words) // 12) or 1)).astype(int)).tolist():
                some = [w for w in words[at : at + 12] if not w.isdigit()]
                if len(some) >= 4:
                    parts.append((some, LANGUAGES.index(lang)))
        # a language with few texts counts as much as one with many, so that names lean to none
        size = np.bincount([y for _, y in parts], minlength=len(LANGUAGES))
        share = size.sum() / len(LANGUAGES) / np.maximum(size, 1)
        for _ in range(rounds):
            for k in rng.permutation(len(parts)):
                some, y = parts[k]
                ids = [cache.setdefault(w, np.array(_grams(w))) if w not in cache else cache[w] for w in some]
                s = sum(weights[i].mean(axis=0) for i in ids)
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                if np.abs(p[y]) < 0.02:
                    continue
                p *= share[y]
                for i in ids:
                    g = p / len(i)
                    squares[i] += g * g
                    weights[i] -= 0.3 * g / np.sqrt(squares[i])
        return cls(weights, {w for w, n in seen.items() if n >= USUAL and not any(c.isdigit() for c in w)})


# ---- features of a pair


def _skeleton(text: str) -> str:
    return " ".join(w.lower() for w in _WORD.findall(text))


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def expected_language(prompt: str, words: list[str], languages: Languages) -> tuple[int, bool, float]:
    """The language the prompt asks for, else its own; whether it was asked for; and the margin of its own."""
    s = languages.scores(words)
    best = max(range(len(s)), key=s.__getitem__)
    margin = s[best] - max(v for k, v in enumerate(s) if k != best)
    asked, at = None, -1
    low = prompt.lower()
    for sentence in re.split(r"(?<=[.?!])\s+|\n", low):
        if _ASKING.search(sentence):
            for pattern, k in _ASKED:
                for m in pattern.finditer(sentence):
                    asked, at = k, m.start()
    return (best if asked is None else asked), at >= 0, margin


def features(answer: str | None, prompt: str | None, languages: Languages, known: set[str]) -> list[int]:
    """Hashed features that hold for a pair."""
    out: list[str] = []
    text = "" if answer is None else "".join(c for c in answer if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    body = text.strip()
    words = _WORD.findall(body)
    low = [w.lower() for w in words]
    n = len(words)
    size = _level(n, (1, 2, 3, 4, 6, 9, 14, 22, 40))
    out.append(f"size {size}")
    skeleton = " ".join(low)
    filler = n == 0 or skeleton in FILLERS
    label = n <= 3 and (skeleton in LABELS) and body.endswith(":")
    out += [f"filler {filler}", f"label {label}", f"nothing {filler or label}"]

    # how it ends
    core = _CITED.sub("", body)
    lines = [x for x in core.split("\n") if x.strip()]
    last = lines[-1].strip() if lines else ""
    item = bool(_ITEM.match(last))
    tail = core.rstrip()[-3:]
    opened = any(core.count(a) > core.count(b) for a, b in ("()", "[]", "“”", "«»")) or body.count("(") > body.count(")")
    final = core.rstrip("\"'”’»)] ")[-1:] if core else ""
    stop = "ellipsis" if tail.endswith(("...", "…")) else "stop" if final in ".!?" and final else "comma" if final in ",;" and final else "colon" if final == ":" else "dash" if final in "-–—(/" and final else "word"
    # the closing mark may be cut off with the word before: what follows the last full stop
    rest = re.split(r"(?<=[.!?])\s+", last)[-1]
    rest_words = _WORD.findall(rest)
    unknown = bool(low) and not low[-1].isdigit() and low[-1] not in known and not words[-1][:1].isupper()
    sentences = len(re.findall(r"[.!?](?=\s|$)", core))
    whole = bool(_WHOLE_ITEM.match(last))
    peers = [x for x in lines if _ITEM.match(x)]
    if item:
        like = len(peers) > 1 and len(_WORD.findall(peers[0])) - len(rest_words) <= 2
        end = f"item {stop} {whole} {unknown} {like}"
    else:
        end = f"{stop} {_level(len(rest_words), (1, 2, 3, 4, 6, 9))} {sentences > 0 or len(lines) > 1}"
    out += [f"end {end}", f"open {opened}", f"stop {stop} {item} {size > 4}", f"unknown {unknown} {stop} {item}", f"open {opened} {stop}"]
    if stop == "word" and not item and low:
        out += [f"last {low[-1]}" if low[-1] in known else "last ?", f"short {size} {unknown} {any(c.isdigit() for c in rest)}"]

    # copies
    if prompt:
        pw = [w.lower() for w in _WORD.findall(prompt)]
        mine = set(zip(low, low[1:], low[2:])) if n > 2 else set()
        theirs = set(zip(pw, pw[1:], pw[2:]))
        both = len(mine & theirs)
        held = both / len(mine) if mine else 0.0
        cover = both / len(theirs) if theirs else 0.0
        out += [f"held {_level(held, (0.05, 0.3, 0.5, 0.7, 0.85, 0.95))}", f"cover {_level(cover, (0.05, 0.2, 0.35, 0.5, 0.7, 0.9))}"]
        out += [f"held {_level(held, (0.3, 0.6, 0.8, 0.95))} cover {_level(cover, (0.2, 0.4, 0.6, 0.8))}"]
        # languages
        want, asked, margin = expected_language(prompt, pw, languages)
        if asked or margin > 1.5:
            plain = [w.lower() for w in _WORD.findall(re.sub(r"[“«„\"][^“”«»„\"]{0,200}[”»“\"]", " ", body)) if not w.isdigit()]
            s = languages.scores(plain)
            other = max((v, k) for k, v in enumerate(s) if k != want)[0]
            gap = other - s[want]
            per = gap / max(len(plain), 1)
            g = _level(gap, (-3, -1, 0, 0.7, 1.5, 3, 6))
            out += [f"gap {g}", f"gap {g} {asked}", f"gap {g} {_level(len(plain), (2, 4, 8, 16))}", f"per {_level(per, (-0.3, -0.1, 0, 0.1, 0.3, 0.6))}"]
    else:
        out.append("no prompt")

    # the pair's features count three times, so that words are learnt only where these do not tell
    out = [f"{k}{x}" for x in out for k in ("a", "b", "c")]
    # words of the whole answer, with names, codes and numbers made alike
    masked = []
    for w, x in zip(words, low):
        name = w[:1].isupper() and x not in known
        masked.append("#" if any(c.isdigit() for c in w) else "Name" if name else x)
    grams = lambda some: [f"{k} " + " ".join(some[i : i + k]) for k in (1, 2, 3) for i in range(len(some) - k + 1)]
    out += grams(["^", *masked[:HEAD]]) + [f"s{size > 6} {x}" for x in set(masked[:HEAD])]
    # behind the beginning they tell refusals only: the other defects are told by the pair's features, which all read the whole answer
    far = grams(masked[HEAD - 2 :]) if n > HEAD else []
    return [*{_bucket(x) for x in out}, *{BUCKETS + _bucket(x) for x in far}]


# ---- the classifier


class Linear:
    """One logistic output a defect, over hashed features; thresholds by defect."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, least: np.ndarray) -> None:
        self.weights, self.bias, self.least = weights, bias, least

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.stack([self.weights[r].sum(axis=0) for r in rows]) + self.bias if rows else np.zeros((0, len(DEFECTS)))

    def judge(self, rows: list[list[int]]) -> list[str | None]:
        s = self.scores(rows) - self.least
        best = s.argmax(axis=1) if len(s) else []
        return [DEFECTS[k] if s[i, k] >= 0 else None for i, k in enumerate(best)]

    @classmethod
    def fit(cls, rows: list[list[int]], labels: np.ndarray, rounds: int = 8, decay: float = 1e-5) -> "Linear":
        rng = np.random.default_rng(11)
        w, b = np.zeros((2 * BUCKETS, len(DEFECTS))), np.full(len(DEFECTS), -2.0)
        g2, b2 = np.full_like(w, 1e-2), np.full(len(DEFECTS), 1e-2)
        arrays = [(a := np.array(r))[a < BUCKETS] for r in rows]
        for _ in range(rounds):
            for k in rng.permutation(len(arrays)):
                r = arrays[k]
                p = 1 / (1 + np.exp(-np.clip(w[r].sum(axis=0) + b, -30, 30)))
                g = p - labels[k]
                if np.abs(g).max() < 0.01:
                    continue
                step = g + decay * w[r]
                g2[r] += step * step
                w[r] -= 0.1 * step / np.sqrt(g2[r])
                b2 += g * g
                b -= 0.1 * g / np.sqrt(b2)
        return cls(w, b, np.zeros(len(DEFECTS)))

    def fit_far(self, rows: list[list[int]], refused: np.ndarray, rounds: int = 8) -> "Linear":
        """Learns what the words behind the beginning tell of refusals; all other weights and the thresholds stay as they are."""
        rng, k = np.random.default_rng(12), DEFECTS.index("refusal")
        w, g2 = self.weights[:, k], np.full(2 * BUCKETS, 1e-2)
        arrays = [np.array(r) for r in rows]
        near = [w[a[a < BUCKETS]].sum() + self.bias[k] - self.least[k] for a in arrays]
        far = [a[a >= BUCKETS] for a in arrays]
        for _ in range(rounds):
            for i in rng.permutation(len(far)):
                g = 1 / (1 + np.exp(-np.clip(near[i] + w[far[i]].sum(), -30, 30))) - refused[i]
                if len(far[i]) and abs(g) >= 0.01:
                    g2[far[i]] += g * g
                    w[far[i]] -= 0.1 * g / np.sqrt(g2[far[i]])
        return self

    def calibrate(self, rows: list[list[int]], labels: np.ndarray) -> "Linear":
        """For each defect the threshold with the best F1 on the examples held back; of those as good, the middle."""
        s = self.scores(rows)
        # good answers are far more frequent in the tables than among the examples
        weight = np.where(labels.any(axis=1), 1.0, GOOD_WEIGHT)
        for k in range(len(DEFECTS)):
            order = np.argsort(-s[:, k])
            hit = np.cumsum(labels[order, k])
            f1 = 2 * hit / (np.cumsum(weight[order]) + labels[:, k].sum())
            best = np.flatnonzero(f1 >= f1.max() - 1e-3)
            self.least[k] = (s[order[best[-1]], k] + s[order[best[0]], k]) / 2
        return self


class Breaker:
    """Breaks good pairs on purpose."""

    def __init__(self, pairs: list[tuple[str, str, int]], seed: int = 7) -> None:
        """``pairs``: answer, prompt, expected language."""
        self.pairs, self.rng = pairs, np.random.default_rng(seed)
        self.by_language: dict[int, list[str]] = {}

    def pick(self, some: list) -> object:
        return some[int(self.rng.integers(len(some)))]

    def filler(self) -> str | None:
        r = self.rng.random()
        if r < 0.1:
            return None
        if r < 0.35:
            return "".join(self.pick([" ", "\n", "\t", "​", "\xa0", ""]) for _ in range(int(self.rng.integers(4))))
        if r < 0.55:
            return self.pick([".", "...", "…", "-", "--", "?", "!", "*", "{}", "[]", '""', "''", "/", "---", "()", "_", "•"])
        if r < 0.8:
            f = self.pick([*FILLERS, "n/a", "N/A", "n.a."])
            f = self.pick([f, f.upper(), f.capitalize()])
            return self.pick(["{}", "<{}>", "[{}]", "({})", "{}.", " {}\n"]).format(f)
        label = self.pick(LABELS)
        return self.pick([label, label.upper(), label.capitalize()]) + self.pick([":", ": ", ":\n"])

    def cut(self, text: str) -> str | None:
        text = _CITED.sub("", text.strip()).rstrip()
        lines = text.split("\n")
        if _ITEM.match(lines[-1]):
            last = lines[-1]
            at = int(self.rng.integers(3, max(4, len(last) - 1)))
            if len(lines) < 2 and self.rng.random() < 0.5:
                return None
            return "\n".join([*lines[:-1], last[:at].rstrip()])
        parts = re.split(r"(?<=[.!?])\s+", text)
        keep = int(self.rng.integers(len(parts)))
        last = parts[keep]
        if len(last) < 30:
            return None
        at = int(self.rng.integers(8, len(last) - 3))
        if self.rng.random() < 0.6:
            at = last.rfind(" ", 0, at) if " " in last[:at] else at
        head = " ".join([*parts[:keep], last[:at].rstrip(" .,;:")])
        if self.rng.random() < 0.15:  # a bracket or quotation that stays open
            before, _, word = head.rpartition(" ")
            return f"{before} {self.pick(['(', '[', '“', '«'])}{word}"
        return head + self.pick(["", "", "", ",", ",", "...", "…", "\n", " (see the", " (", "-", ":"])

    def refusal(self, language: int) -> str:
        opening, body, ground, closing = REFUSALS[LANGUAGES[language] if self.rng.random() < 0.85 else "en"]
        name, word = self.some_name(), self.some_word()
        o, b, g, c = self.pick(opening), self.pick(body), self.pick(ground), self.pick(closing)
        text = (o + b + g).format(n=name, w=word, c=self.some_code())
        text = text[:1].upper() + text[1:] + self.pick([".", ".", ".", "", "!"]) + c
        return text.upper() if self.rng.random() < 0.1 else text

    def preamble(self, language: int) -> str:
        """Sentences of other answers and prompts in a language, 15 to 120 words and what the last sentence has over."""
        some, words, most = [], 0, int(self.rng.integers(15, 120))
        for _ in range(40):
            if words >= most:
                break
            answer, prompt, k = self.pick(self.pairs)
            if k == language:
                sentence = self.pick(re.split(r"(?<=[.?!])\s+", self.pick([answer, prompt]).strip()))
                if sentence.endswith((".", "?", "!")):
                    some.append(sentence)
                    words += len(sentence.split())
        return " ".join(some)

    def some_name(self) -> str:
        found = re.findall(r"\b[A-Z][a-z]{4,}(?: [A-Z][a-z]+)?\b", self.pick(self.pairs)[1])
        return self.pick(["", "the " + self.some_word() + " of "]) + (self.pick(found) if found else "the owner")

    def short(self) -> str:
        found = re.findall(r"\b[A-Z][a-z]{4,}(?: [A-Z][a-z]+)?\b|\b[A-Z]{2}-\d+\b|\b\d+ [a-zäöüéèáíóñ]{4,}\b|\b(?:[Tt]able|Tabelle|tableau|cuadro) \d+", self.pick(self.pairs)[1])
        return self.pick(found) if found else "12"

    def some_word(self) -> str:
        found = re.findall(r"\b[a-zäöüéèáíóñ]{5,}\b", self.pick(self.pairs)[1])
        return self.pick(found) if found else "records"

    def some_code(self) -> str:
        found = _CODE.findall(self.pick(self.pairs)[1])
        return self.pick(found) if found else "A-1"

    def copy(self, prompt: str) -> str:
        parts = re.split(r"(?<=[.?!])\s+", prompt.strip())
        r = self.rng.random()
        if r < 0.3 or len(parts) < 3:
            text = prompt.strip()
        elif r < 0.6:
            text = " ".join(parts[:-1])
        elif r < 0.8:
            text = " ".join(parts[1:])
        else:
            gone = int(self.rng.integers(len(parts)))
            text = " ".join(p for i, p in enumerate(parts) if i != gone)
        r = self.rng.random()
        if r < 0.15:
            text = re.sub(r"[.?!,;:]", "", text)
        elif r < 0.25:
            text = text.lower()
        elif r < 0.3:
            text = text.upper()
        elif r < 0.45:
            text = self.pick(["Question: ", "Q: ", "The question is: ", "You asked: ", "> "]) + text
        elif r < 0.55:
            ws = text.split()
            for _ in range(3):
                del ws[int(self.rng.integers(len(ws)))]
            text = " ".join(ws)
        return text

    def swap(self, language: int) -> str | None:
        others = [k for k in self.by_language if k != language and self.by_language[k]]
        return self.pick(self.by_language[self.pick(others)]) if others else None


def _examples(pairs: list[tuple[str, str, int]], languages: Languages, seed: int, own: list[int]) -> tuple[list[tuple[str | None, str]], np.ndarray]:
    """Good pairs and broken ones, with their labels; ``own``: the language each answer is in, -1 unknown."""
    b = Breaker(pairs, seed)
    for (answer, _, _), k in zip(pairs, own):
        if k >= 0:
            b.by_language.setdefault(k, []).append(answer)
    rows: list[tuple[str | None, str]] = []
    labels: list[int] = []
    for answer, prompt, language in pairs:
        rows.append((answer, prompt))
        labels.append(-1)
        r = b.rng.random()
        # good answers that look like bad ones: they begin with the question, or are a mere name or number
        if r < 0.35:
            asked = b.pick(re.split(r"(?<=[.?!])\s+", prompt.strip()))
            rows.append((asked.rstrip(".?!") + b.pick([": ", ": ", ". ", "? "]) + answer, prompt))
            labels.append(-1)
        elif r < 0.5:
            rows.append((b.short(), prompt))
            labels.append(-1)
        r = b.rng.random()
        for k, got in ((0, b.filler() if r < 0.3 else "skip"), (1, b.cut(answer)), (2, b.refusal(language) if b.rng.random() < 0.7 else "skip"), (3, b.copy(prompt) if b.rng.random() < 0.6 else "skip"), (4, b.swap(language) if b.rng.random() < 0.7 else None)):
            if got == "skip" or (got is None and k > 0):
                continue
            rows.append((got, prompt))
            labels.append(k)
    y = np.zeros((len(rows), len(DEFECTS)))
    for i, k in enumerate(labels):
        if k >= 0:
            y[i, k] = 1
    return rows, y


def _far_examples(pairs: list[tuple[str, str, int]], seed: int) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Refusals after a preamble, at times with more behind, and good answers as long; and which are refusals."""
    b, rows, refused = Breaker(pairs, seed), [], []
    for answer, prompt, language in pairs:
        r = b.rng.random()
        for parts in ([b.preamble(language), b.refusal(language), b.preamble(language) if r < 0.2 else ""], [b.preamble(language), answer]):
            rows.append((" ".join(x for x in parts if x), prompt))
            refused.append(len(parts) == 3)
    return rows, np.array(refused, float)


class Judge:
    """The fitted models and what their features need."""

    def __init__(self, languages: Languages, known: set[str], linear: Linear) -> None:
        self.languages, self.known, self.linear = languages, known, linear

    def features(self, pairs: list[tuple[str | None, str | None]]) -> list[list[int]]:
        return [features(a, p, self.languages, self.known) for a, p in pairs]

    def __call__(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        return self.linear.judge(self.features(pairs))

    @classmethod
    def fit(cls, pairs: list[tuple[str, str]], texts: list[str], langs: list[str], seed: int = 7) -> "Judge":
        languages = Languages.fit(texts, langs)
        count: dict[str, int] = {}
        for a, p in pairs:
            for w in {x.lower() for x in _WORD.findall(a) if not x[:1].isupper()} | {x.lower() for x in _WORD.findall(p) if not x[:1].isupper()}:
                count[w] = count.get(w, 0) + 1
        self = cls(languages, {w for w, n in count.items() if n >= 3}, None)  # type: ignore[arg-type]
        good = [(a, p) for a, p in pairs if a and p]

        def fitted(some: list[tuple[str, str]], seed: int, far: bool = False) -> Linear:
            full, own = [], []
            for a, p in some:
                full.append((a, p, expected_language(p, [w.lower() for w in _WORD.findall(p)], languages)[0]))
                top = sorted(s := languages.scores([w.lower() for w in _WORD.findall(a)]))
                own.append(int(np.argmax(s)) if top[-1] - top[-2] > 1.5 else -1)
            rows, y = _examples(full, languages, seed, own)
            x = self.features(rows)
            held = np.arange(len(x)) % 5 == 0
            model = Linear.fit([x[i] for i in np.flatnonzero(~held)], y[~held])
            model.calibrate([x[i] for i in np.flatnonzero(held)], y[held])
            if not far:
                return model
            more, refused = _far_examples(full, seed + 100)
            return model.fit_far(self.features(more) + x, np.concatenate([refused, y[:, DEFECTS.index("refusal")]]))

        # each half is looked through by a model that has not seen it; what it doubts is not taken as good
        halves = good[::2], good[1::2]
        sure: list[tuple[str, str]] = []
        for k in (0, 1):
            if halves[k] and halves[1 - k]:
                doubt = fitted(halves[k], seed + k).scores(self.features(halves[1 - k])).max(axis=1)
                sure += [g for g, v in zip(halves[1 - k], doubt) if v < DOUBT]
        self.linear = fitted(sure or good, seed + 2, True) if good else Linear(np.zeros((2 * BUCKETS, len(DEFECTS))), np.zeros(len(DEFECTS)), np.full(len(DEFECTS), np.inf))
        return self


def _judge_batches(judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge.value(list(zip(batch.column("answer").to_pylist(), batch.column("prompt").to_pylist())))
            keep = pa.array([v is not None for v in found])
            out = pa.RecordBatch.from_arrays([batch.column("table_name"), batch.column("row_id"), pa.array(found, pa.string())], names=["table_name", "row_id", "defect"])
            yield out.filter(keep)

    return run


def sample_of(df: DataFrame, key: Column, rows: int) -> pd.DataFrame:
    """The rows with the least hashes of their key: the same ones at every run, however the table is stored.

    Tasks send only rows under a bound that lets through a few more than wanted, so that what reaches the driver does not grow with the
    table; should it let through too few (many rows with one key), it is raised.
    """
    hashed = df.withColumn("__h", F.xxhash64(key))
    total = hashed.count()
    share = (rows + 6 * rows**0.5 + 50) / max(total, 1)
    while True:
        some = hashed if share >= 1 else hashed.where(F.col("__h") < int(-(2**63) + share * 2**64))
        got = some.orderBy("__h").limit(rows).toPandas()
        if share >= 1 or len(got) >= min(rows, total):
            return got.drop(columns="__h")
        share *= 2


def defective(pairs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, language_sample: int = LANGUAGE_SAMPLE) -> DataFrame:
    """(table_name, row_id, defect). ``pairs``: table_name, row_id, answer, prompt; ``labelled``: id, text, lang."""
    spark = pairs.sparkSession
    some = sample_of(pairs.where("answer is not null and prompt is not null"), F.struct("table_name", "row_id"), sample)
    texts = sample_of(labelled.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("id", "text", "lang"), F.col("id"), language_sample)
    judge = Judge.fit(list(zip(some["answer"], some["prompt"])), texts["text"].tolist(), texts["lang"].tolist())
    held = spark.sparkContext.broadcast(judge)
    kind = pairs.schema["row_id"].dataType.simpleString()
    return pairs.select("table_name", "row_id", "answer", "prompt").mapInArrow(_judge_batches(held), f"table_name string, row_id {kind}, defect string")


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "training_samples").select(F.lit("training_samples").alias("table_name"), "row_id", F.col("target_answer").alias("answer"), "prompt")
    # a task may be delivered twice
    tasks = table(spark, sf_dir, "tasks").groupBy("task_id").agg(F.min("prompt").alias("prompt"))
    responses = table(spark, sf_dir, "no_rag_responses").join(tasks, "task_id", "left").select(F.lit("no_rag_responses").alias("table_name"), "row_id", "answer", "prompt")
    return samples.unionByName(responses)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective(answer_pairs(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang"))
