"""A spectrum of 32 peaks."""

# Fixed values.
PEAKS = [
    1352.555, 1377.5867, 1393.5816, 1434.6082, 1514.6078, 1522.6242, 1539.6395, 1555.6344, 1580.6661, 1596.661, 1637.6876, 1660.6657, 1668.6821, 1676.6606, 1684.677, 1701.6923,
    1717.6872, 1742.7189, 1758.7138, 1783.7455, 1799.7404, 1830.7349, 1838.7134, 1846.7298, 1887.7564, 1904.7717, 1945.7983, 1992.7877, 2000.7662, 2008.7826, 2033.8143, 2049.8092,
]
COMMON = 1028.357059
NAMES = ("Hex", "HexNAc", "dHex", "NeuAc")
MASSES = (162.052824, 203.079374, 146.05791, 291.095419)


def peaks(spark, *samples):
    rows = [(s, k + 1, m) for s in (samples or ("s",)) for k, m in enumerate(PEAKS)]
    return spark.createDataFrame(rows, "sample_id string, peak_id int, observed double")
