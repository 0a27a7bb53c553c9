"""Fixed values shared by the operators."""

# Three-letter residue names and the letter each one maps to.
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "CYX": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIE": "H", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SEC": "U",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}

# The twenty standard residue letters, alphabetical.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Residue-pair contacts.
CONTACT_CUTOFF = 8.0
MIN_SEPARATION = 6
MIN_CHAIN_LENGTH = 20

# Retrieval, chunking and numeric guards.
TOP_K = 4
CHUNK_LENGTH = 1022
EPSILON = 1e-8

# Alignment scores (linear gap).
MATCH = 1
MISMATCH = -1
GAP = 2

# Upper ends of the relative-position buckets.
RELPOS_CUTS = (0, 1, 2, 3, 4, 5, 8, 12, 16, 24, 32, 48, 64)

# Loss settings.
LABEL_SMOOTHING = 0.05
POS_WEIGHT_SCALE = 0.8
TVERSKY_ALPHA = 0.7
TVERSKY_BETA = 0.3
TVERSKY_GAMMA = 1.0
TVERSKY_WEIGHT = 0.3

# Split settings and early stopping.
VAL_RATIO = 0.1
SEED = 42
PATIENCE = 5

# Residue tokens in vocabulary order.
RESIDUE_TOKENS = [
    "L", "A", "G", "V", "S", "E", "R", "T", "I", "D", "P", "K", "Q", "N", "F", "Y", "M", "H", "W", "C", "X", "B", "U", "Z", "O", ".", "-",
]

# Special tokens before and after the residues, and whether a
# sequence gets a start and an end token, per model family.
VOCAB_LAYOUTS = {
    "base": (("<null_0>", "<pad>", "<eos>", "<unk>"), ("<cls>", "<mask>", "<sep>"), True, False),
    "roberta": (("<cls>", "<pad>", "<eos>", "<unk>"), ("<mask>",), True, True),
    "msa": (("<cls>", "<pad>", "<eos>", "<unk>"), ("<mask>",), True, False),
    "structure": (("<null_0>", "<pad>", "<eos>", "<unk>"), ("<mask>", "<cath>", "<af2>"), True, False),
}

# BLOSUM62 (Henikoff & Henikoff 1992), lower triangle, one row
# per letter in the order of BLOSUM62_LETTERS.
BLOSUM62_LETTERS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62_ROWS = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""


def blosum62_pairs() -> list[tuple[str, str, int]]:
    """All ordered letter pairs with their BLOSUM62 score."""
    pairs = {}
    for a, row in zip(BLOSUM62_LETTERS, BLOSUM62_ROWS.split("\n")[1:]):
        for b, score in zip(BLOSUM62_LETTERS, row.split()):
            pairs[a, b] = pairs[b, a] = int(score)
    return [(a, b, s) for (a, b), s in sorted(pairs.items())]
