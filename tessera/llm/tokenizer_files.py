"""Vocabulary files of public tokenizers, which every machine of a cluster has installed."""

from __future__ import annotations

import os

FOLDER = "/opt/tokenizers"
PIECES = os.path.join(FOLDER, "piece_bpe_32k.model")
WORDS = os.path.join(FOLDER, "word_bpe_49k.json")
