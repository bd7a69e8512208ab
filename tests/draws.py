"""The hash draws in plain Python, for step-by-step models of the operators."""

import hashlib


def h_hex(seed, *keys):
    return hashlib.md5("|".join([str(seed), *map(str, keys)]).encode()).hexdigest()


def h_int(seed, *keys):
    return int(h_hex(seed, *keys)[:15], 16)


def uniform(seed, *keys):
    return h_int(seed, *keys) / float(1 << 60)


def below(bound, seed, *keys):
    return h_int(seed, *keys) % bound
