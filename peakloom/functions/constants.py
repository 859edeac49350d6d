"""Masses, corrections and the block dictionary."""

from __future__ import annotations

# Fixed values (monoisotopic masses in Da).
HYDROGEN = 1.00784
SODIUM = 22.989769
OXYGEN = 15.994915
MASS_UNIT = 1.00035

ADDUCT_MASS = {"neg_h": -HYDROGEN, "pos_na": SODIUM, "pos_h": HYDROGEN}
REDUCTION_MASS = {"nr": 0.0, "r": -2 * HYDROGEN, "red_end": 2 * HYDROGEN + OXYGEN}

# Name, mass, category, default limit, glycan type, full name.
BLOCKS_TSV = """\
_free_red_end	18.0105546	meta	0	native	Free reducing end
Hex	162.052824	common	10	native	Hexose
dHex	146.05791	common	3	native	Deoxyhexose (e.g. fucose)
HexNAc	203.079374	common	8	native	N-Acetylhexosamine
NeuAc	291.095419	common	4	native	N-Acetylneuraminic acid
NeuGc	307.090334	rare	4	native	N-Glycolylneuraminic acid
KDN	250.068870	rare	4	native	Deaminoneuraminic acid
HexA	176.03209	rare	4	native	Hexuronic acid
HexN	161.068809	rare	4	native	Hexosamine
dHexNAc	187.084459	rare	4	native	N-Acetyldeoxyhexosamine
Pent	132.04226	rare	4	native	Pentose (e.g. xylose)
dPent	116.047345	rare	4	native	Deoxypentose (e.g. deoxyribose)
Tet	102.031695	rare	4	native	Tetrose
PhSu	79.961	mod	1	native	Phosphate or sulfate
Ac	42.01111	mod	1	native	Acetyl
ChoP	182.058207	mod	1	native	Phosphorylcholinyl
PEA	139.003447	mod	1	native	Phosphoethanolaminyl
_free_red_end	46.0419	meta	0	permethylated	Free reducing end
Hex	204.0998	common	10	permethylated	Hexose
dHex	174.0892	common	3	permethylated	Deoxyhexose (e.g. fucose)
HexNAc	245.1263	common	8	permethylated	N-Acetylhexosamine
NeuAc	361.1737	common	4	permethylated	N-Acetylneuraminic acid
NeuGc	391.1842	rare	4	permethylated	N-Glycolylneuraminic acid
KDN	320.1472	rare	4	permethylated	Deaminoneuraminic acid
HexA	218.079	rare	4	permethylated	Hexuronic acid
dHexNAc	217.095059	rare	4	permethylated	N-Acetyldeoxyhexosamine
Pent	160.0736	rare	4	permethylated	Pentose (e.g. xylose)
Tet	116.0474	rare	4	permethylated	Tetrose
Ph	93.982	mod	1	permethylated	Phosphate
Su	65.9412	mod	1	permethylated	Sulfate
_free_red_end	102.0317	meta	0	peracetylated	Free reducing end
Hex	288.0845	common	10	peracetylated	Hexose
dHex	230.079	common	3	peracetylated	Deoxyhexose (e.g. fucose)
HexNAc	287.1005	common	8	peracetylated	N-Acetylhexosamine
NeuAc	417.1271	common	4	peracetylated	N-Acetylneuraminic acid
NeuGc	475.1326	rare	4	peracetylated	N-Glycolylneuraminic acid
KDN	376.1006	rare	4	peracetylated	Deaminoneuraminic acid
HexA	260.0532	rare	4	peracetylated	Hexuronic acid
Pent	216.0634	rare	4	peracetylated	Pentose (e.g. xylose)
PhSu	37.95105	mod	1	peracetylated	Phosphate or sulfate
"""

# Name, mass, description.
LABELS_TSV = """\
2-AA	137.047679	2-Aminobenzoic acid (anthranilic acid)
2-AB	136.063663	2-Aminobenzamide (anthranilamide)
3-AQ	144.068748	3-Aminoquinoline
"""

DEFAULT_COMMON = {"Hex": 3, "HexNAc": 2}
