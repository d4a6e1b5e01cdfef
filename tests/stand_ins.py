"""Models that tests name on the command line: word vectors by length, and a scorer that likes shared words."""

import numpy as np


def encoder():
    return lambda texts: [np.eye(8)[[len(w) % 8 for w in t.split()] or [0]] for t in texts]


def scorer():
    return lambda pairs: np.array([float(len(set(q.lower().split()) & set(p.lower().split()))) for q, p in pairs])
