"""Residue scales and dimension tables: fixed, published values."""

from __future__ import annotations

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

#: Average masses of free amino acids (Da), and of water.
MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729,
    "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
WATER = 18.0153
ACETYL, AMIDE = 42.037, -0.985

#: The normalised consensus hydrophobicity scale (Eisenberg 1984).
EISENBERG = {
    "A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06,
    "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26,
}

#: Hydropathy (Kyte-Doolittle 1982).
KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

#: Protein-protein interaction potential (Boman 2003).
BOMAN = {
    "A": 1.81, "C": 1.28, "D": -8.72, "E": -6.81, "F": 2.98, "G": 0.94, "H": -4.66, "I": 4.92, "K": -5.55, "L": 4.92,
    "M": 2.35, "N": -6.64, "P": 0.0, "Q": -5.54, "R": -14.92, "S": -3.40, "T": -2.57, "V": 4.04, "W": 2.33, "Y": -0.14,
}

SCALES = {"eisenberg": EISENBERG, "kyte_doolittle": KYTE_DOOLITTLE, "boman": BOMAN}

#: pK of side chains and termini (Bjellqvist 1993).
PK_POSITIVE = {"H": 5.98, "K": 10.0, "R": 12.0}
PK_NEGATIVE = {"C": 9.0, "D": 4.05, "E": 4.45, "Y": 10.0}
PK_N_TERM, PK_C_TERM = 7.5, 3.55
PK_N_TERM_OF = {"A": 7.59, "E": 7.7, "M": 7.0, "P": 8.36, "S": 6.93, "T": 6.82, "V": 7.44}
PK_C_TERM_OF = {"D": 4.55, "E": 4.75}

#: Residue classes.
CLASSES = {"aliphatic": "AILV", "aromatic": "FHWY", "charged": "DEHKR", "hydrophobic": "ACFILMVW", "negative": "DE", "polar": "CNQSTY", "positive": "HKR", "small": "ACDGNPSTV"}
#: Five physico-chemical groups.
GROUPS = {"aliphatic": "GAVLMI", "aromatic": "FYW", "positive": "KRH", "negative": "DE", "uncharged": "STCPNQ"}
#: Composition / transition / distribution groups of seven properties (Dubchak 1995).
CTD = {
    "charge": ("KR", "ANCQGHILMFPSTWYV", "DE"),
    "hydrophobicity": ("RKEDQN", "GASTPHY", "CLVIMFW"),
    "polarity": ("LIFWCMVY", "PATGS", "HQRKNED"),
    "polarizability": ("GASDT", "CPNVEQIL", "KMHFRYW"),
    "secondary_structure": ("EALMQKRH", "VIYCWFT", "GNPSD"),
    "solvent_access": ("ALFCGIVW", "RKQEND", "MSPTHY"),
    "volume": ("GASTPDC", "NVEQIL", "MHKFRYW"),
}
#: Seven classes of the conjoint triads.
TRIADS = ("AGV", "ILFP", "YMTS", "HNQW", "RK", "DE", "C")
#: Atoms (C, H, N, O, S) of each free residue.
ATOMS = {
    "A": (3, 7, 1, 2, 0), "C": (3, 7, 1, 2, 1), "D": (4, 7, 1, 4, 0), "E": (5, 9, 1, 4, 0), "F": (9, 11, 1, 2, 0), "G": (2, 5, 1, 2, 0), "H": (6, 9, 3, 2, 0),
    "I": (6, 13, 1, 2, 0), "K": (6, 14, 2, 2, 0), "L": (6, 13, 1, 2, 0), "M": (5, 11, 1, 2, 1), "N": (4, 8, 2, 3, 0), "P": (5, 9, 1, 2, 0), "Q": (5, 10, 2, 3, 0),
    "R": (6, 14, 4, 2, 0), "S": (3, 7, 1, 3, 0), "T": (4, 9, 1, 3, 0), "V": (5, 11, 1, 2, 0), "W": (11, 12, 2, 2, 0), "Y": (9, 11, 1, 3, 0),
}
#: Dipeptide instability weights (Guruprasad 1990); pairs that aren't listed weigh DIWV_DEFAULT.
DIWV_DEFAULT = 1.0
DIWV = {
    "AC": 44.94, "AD": -7.49, "AH": -7.49, "AP": 20.26, "CD": 20.26, "CE": 20.26, "CH": 33.6, "CL": 20.26, "CM": 33.6, "CP": 20.26, "CQ": -6.54,
    "CT": 33.6, "CV": -6.54, "CW": 24.68, "DF": -6.54, "DK": -7.49, "DR": -6.54, "DT": -14.03, "EC": 44.94, "ED": 20.26, "EE": 33.6, "EH": -6.54,
    "EI": 20.26, "EQ": 20.26, "ES": 20.26, "EW": -14.03, "FD": 13.34, "FK": -14.03, "FP": 20.26, "FY": 33.601, "GA": -7.49, "GE": -6.54, "GG": 13.34,
    "GI": -7.49, "GK": -7.49, "GN": -7.49, "GT": -7.49, "GW": 13.34, "GY": -7.49, "HF": -9.37, "HG": -9.37, "HI": 44.94, "HK": 24.68, "HN": 24.68,
    "HP": -1.88, "HT": -6.54, "HW": -1.88, "HY": 44.94, "IE": 44.94, "IH": 13.34, "IK": -7.49, "IL": 20.26, "IP": -1.88, "IV": -7.49, "KG": -7.49,
    "KI": -7.49, "KL": -7.49, "KM": 33.6, "KP": -6.54, "KQ": 24.64, "KR": 33.6, "KV": -1.88, "LK": -7.49, "LP": 20.26, "LQ": 33.6, "LR": 20.26,
    "LW": 24.68, "MA": 13.34, "MH": 58.28, "MM": -1.88, "MP": 44.94, "MQ": -6.54, "MR": -6.54, "MS": 44.94, "MT": -1.88, "MY": 24.68, "NC": -1.88,
    "NG": -14.03, "NI": 44.94, "NK": 24.68, "NP": -1.88, "NQ": -6.54, "NT": -7.49, "NW": -9.37, "PA": 20.26, "PC": -6.54, "PD": -6.54, "PE": 18.38,
    "PF": 20.26, "PM": -6.54, "PP": 20.26, "PQ": 20.26, "PR": -6.54, "PS": 20.26, "PV": 20.26, "PW": -1.88, "QC": -6.54, "QE": 20.26, "QF": -6.54,
    "QP": 20.26, "QQ": 20.26, "QS": 44.94, "QV": -6.54, "QY": -6.54, "RG": -7.49, "RH": 20.26, "RN": 13.34, "RP": 20.26, "RQ": 20.26, "RR": 58.28,
    "RS": 44.94, "RW": 58.28, "RY": -6.54, "SC": 33.6, "SE": 20.26, "SP": 44.94, "SQ": 20.26, "SR": 20.26, "SS": 20.26, "TF": 13.34, "TG": -7.49,
    "TN": -14.03, "TQ": -6.54, "TW": -14.03, "VD": -14.03, "VG": -7.49, "VK": -1.88, "VP": 20.26, "VT": -7.49, "VY": -6.54, "WA": -14.03,
    "WG": -9.37, "WH": 24.68, "WL": 13.34, "WM": 24.68, "WN": 13.34, "WT": -14.03, "WV": -7.49, "YD": 24.68, "YE": -6.54, "YG": -7.49, "YH": 13.34,
    "YM": 44.94, "YP": 13.34, "YR": -15.91, "YT": -7.49, "YW": -9.37, "YY": 13.34,
}

#: The three properties of pseudo-composition (hydrophobicity, hydrophilicity, side-chain mass), by residue in the order
#: ARNDCQEGHILKMFPSTWYV.
_PSEUDO_ORDER = "ARNDCQEGHILKMFPSTWYV"
PSEUDO = {
    "hb": [0.62, -2.53, -0.78, -0.9, 0.29, -0.85, -0.74, 0.48, -0.4, 1.38, 1.06, -1.5, 0.64, 1.19, 0.12, -0.18, -0.05, 0.81, 0.26, 1.08],
    "hl": [-0.5, 3, 0.2, 3, -1, 0.2, 3, 0, -0.5, -1.8, -1.8, 3, -1.3, -2.5, 0, 0.3, -0.4, -3.4, -2.3, -1.5],
    "sc": [15, 101, 58, 59, 47, 72, 73, 1, 82, 57, 57, 73, 75, 91, 42, 31, 45, 130, 107, 43],
}
PSEUDO = {n: dict(zip(_PSEUDO_ORDER, map(float, v), strict=True)) for n, v in PSEUDO.items()}
