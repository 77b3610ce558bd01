"""Prediction by partial matching over whole texts, written plainly with dictionaries."""

import math
import zlib
from collections import defaultdict

END, STOP = "end of word", "end of text"


class Plain:
    def __init__(self, documents, order):
        self.order = order
        self.counts = defaultdict(lambda: defaultdict(int))
        self.tokens = defaultdict(int)
        for doc_id, text in documents:
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2:
                continue
            for word in self.words(text):
                self.tokens[word] += 1
            for context, sign in self.steps(text):
                for k in range(len(context) + 1):
                    self.counts[context[len(context) - k :]][sign] += 1
        self.total = sum(self.tokens.values())

    def words(self, text):
        return [*(text or "").encode().lower().split(), b""]

    def steps(self, text):
        signs = [END]
        for word in self.words(text):
            signs += [*word, END] if word else [STOP]
        for i in range(1, len(signs)):
            yield tuple(signs[max(0, i - self.order) : i]), signs[i]

    def sign(self, context, sign):
        out, excluded = 0.0, set()
        while True:
            here = {s: n for s, n in self.counts.get(context, {}).items() if s not in excluded}
            weight = sum(here.values()) + len(here)
            if sign in here:
                return out + math.log10(here[sign] / weight)
            if here:
                out += math.log10(len(here) / weight)
            excluded |= set(here)
            if not context:
                return out - math.log10(258 - len(excluded))
            context = context[1:]

    def document(self, doc_id, text):
        words = self.words(text)
        v = len(self.tokens)
        base = sum(math.log10((self.tokens.get(w, 0) + 1) / (self.total + v + 1)) for w in words)
        score = sum(self.sign(c, s) for c, s in self.steps(text))
        return len(words), sum(w in self.tokens for w in words), self.total, base, score
