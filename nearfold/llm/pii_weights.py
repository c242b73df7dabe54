"""Weights that pii.train gives: a row for each kind by feature; then for each kind before by kind."""

WEIGHT = [
    [0.2134, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000, -0.6922, 1.4391, -1.9298, -0.3866, 0.8816, -0.9015, -1.2520, -0.0436, -0.0436, -0.1844, -1.2525, 0.4899, -0.6405, 0.8125, -0.5422, -0.6409, 0.2293, -0.0533, -0.8864, -0.6014, -0.4623, 0.2529, 0.0000, 0.0000, 0.5566, -0.0312, 1.6906, 2.6098, 0.0000, 0.1178, -0.2669],
    [-1.6778, -0.9028, -0.6496, -0.3502, -0.0967, -0.0442, -0.0190, -0.0127, -0.0066, 2.5175, -0.6504, -0.4119, -0.4152, -0.3486, -0.1041, -0.4251, -0.0200, -0.0140, -0.0929, -0.2863, -0.0554, -0.1648, 0.4080, -0.0154, -1.1085, -0.8386, -0.5138, 2.8171, -0.3673, 0.3401, -2.6132, -0.1225, -0.4911, 1.0051, -0.1811, -0.2447, -0.0821, -0.0077, -0.8817, -0.3387],
    [-1.1070, -1.6634, -0.6020, 1.8682, 0.8671, 1.1285, -0.1263, -0.0491, -0.0257, -0.1968, -1.0425, -0.4156, 3.2878, -0.8862, -0.2050, -0.5417, -0.0346, -0.0307, -0.4748, -0.2163, -0.0086, -0.1711, -0.1801, -1.1970, -2.2040, 1.9418, -1.0428, -0.2299, -0.1809, 0.8060, -2.8669, -0.4462, -0.6949, -1.2295, -0.4081, -0.6667, -0.0040, -0.0108, -0.6077, -4.1754],
    [-1.4464, -0.5015, -0.2020, -0.3523, 0.2443, -0.0798, -0.0343, -0.0451, -0.0300, -0.0996, -0.2721, -0.1617, -0.4118, 1.9271, 3.5440, -0.3907, -0.0423, -0.0366, -0.2411, -0.2542, -0.0284, 0.1236, -0.1411, -1.2813, -1.1137, -0.6422, 1.0432, -0.1445, -0.1931, 0.2486, -2.3199, -0.2602, -0.3424, -0.4178, -0.1740, -2.0820, -0.0288, -0.0042, -0.4784, -1.4128],
    [-1.4911, -0.6023, -0.7039, -0.3283, -0.1189, -0.0730, -0.0496, -0.0250, -0.0129, -0.1319, 1.3563, 3.8304, -0.6346, -0.2693, -0.0741, -0.1899, -0.0127, -0.0092, -0.0996, -0.2111, -0.0517, -0.1298, -0.1428, -1.2306, -0.9282, 0.3946, -0.4332, -0.2024, -0.1857, -0.1188, -2.3237, -0.1934, -0.3259, 0.9251, -0.1299, -0.1930, -2.3441, -0.0074, -0.4321, -0.1979],
    [-1.0107, -0.7068, -0.8226, -0.5099, -0.1529, -0.0828, -0.0304, -0.0205, -0.0120, -0.3829, -0.5773, -0.3716, -0.9033, -0.8770, -0.2966, 4.4138, -0.1000, -0.0595, -0.3967, -0.8682, -0.0425, 0.5367, 0.7171, -0.7211, -0.6795, -0.6944, -0.1990, -0.4567, -0.3041, 1.0908, -2.8588, -0.1613, -0.3201, -0.7316, -0.0707, -0.5701, -0.0808, -0.0051, -0.5422, -0.6062],
    [-0.9561, 0.4624, 0.1921, -0.4732, -0.1209, -0.0609, -0.0233, -0.0176, -0.0131, -0.3970, -0.4245, -0.2618, -1.1246, -0.7935, -0.2678, -0.8567, 4.1534, 1.7364, -0.3766, -0.5084, -0.0184, 0.6194, 1.3329, -0.7397, -1.4476, -1.0165, -0.4263, -0.5530, 1.7372, 0.8817, -3.2803, -0.1456, 0.9779, -0.7007, -0.3116, -0.5176, -0.0501, -0.0346, -0.7336, -0.5962],
    [-0.9682, -0.7409, 0.1987, -1.5060, -0.5768, 1.0118, 0.5899, 0.8348, 1.7269, -0.2517, -0.6299, -0.3129, -1.0073, -1.3640, -0.5476, -0.9244, -0.1497, -0.1343, 4.9589, -0.5660, -0.0296, -0.3704, -0.2566, -1.4995, -1.5008, -0.2202, 1.6448, -0.2980, -0.2703, 1.0029, -2.7773, -0.5383, -0.5015, -0.7923, -0.3015, -0.7836, -0.0394, -0.0040, -0.5745, -3.1687],
    [-1.4164, -0.6834, -0.9319, -0.4692, -0.2009, -0.0870, -0.0298, -0.0109, -0.0051, -0.2052, -0.6141, -0.5171, -0.8780, -0.4709, -0.1398, -0.8174, -0.0490, -0.0393, -0.1424, 3.9112, -0.1006, -0.2128, -0.1478, -1.0318, 0.7600, -0.6783, -0.6343, -0.2304, -0.1539, 0.9627, -2.9119, -0.2091, -0.3277, -0.7377, -0.0458, -0.3319, -0.1443, -0.0044, -0.4983, -0.4355],
]
CHAIN = [
    [0.2468, -0.5839, -0.7295, -0.5920, -0.6691, -0.4480, -0.5702, -0.2183, -0.5169],
    [-0.0127, -0.1670, -0.3728, -0.1368, -0.3419, -0.1182, -0.2103, -0.1444, -0.1126],
    [-0.1419, -0.0741, -0.1343, -0.3197, -0.4995, -0.1531, 0.4255, -0.3698, -0.2434],
    [-0.5404, -0.0733, 0.3633, -0.2142, -0.1405, -0.1671, -0.1376, -0.0659, -0.2780],
    [-0.2014, -0.1113, -0.0727, -0.1018, -0.2177, -0.1040, -0.1646, -0.2465, -0.3144],
    [-0.4327, -0.0923, -0.0537, -0.2005, -0.1660, -0.0736, -0.0299, -0.0504, -0.0773],
    [-0.1886, -0.1111, -0.1984, -0.1088, -0.0441, -0.0363, -0.2777, -0.0667, -0.1681],
    [-0.2945, -0.1212, -0.4272, -0.0347, -0.1577, -0.0099, -0.1755, -0.1478, 0.0331],
    [-0.3433, -0.2526, -0.1500, -0.1037, -0.2137, -0.0676, -0.1120, -0.1493, -0.0669],
    [0.5479, -0.3929, 0.0348, -0.0533, -0.2000, -0.2172, -0.1911, -0.0507, -0.1056],
]
