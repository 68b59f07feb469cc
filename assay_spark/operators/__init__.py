"""DataFrame -> DataFrame operators, one module per family.

- ``select``: projections, filters, predicates (P1-P16)
- ``joins``: keyed joins (J1-J6, J9, J10)
- ``profile``: describe, moments, quantiles, histograms, box stats, correlation (A1-A4, A9-A16)
- ``sampling``: exact repeatable draws and splits (M1-M5, W1, W3, J6, E6)
- ``reshape``: long/wide, nested scores, transpose (R1-R5)
- ``features``: standardise, impute, scale, expansions, response, noise, PCA, embed (F1-F10)
- ``kernels``: kNN, RBF kernel, centroid assignment (J7, J8, C2, L7)
- ``cluster``: k-means and elbow (C1, C3)
- ``models``: estimators, grouped fits, evaluation grid (L1-L9, G1, G2)
- ``importance``: feature rankings (F12, F13, A13, T2)
- ``report``: metrics and roll-ups (A5-A8, A14, A17, T1, E1-E5, J4, J5)
"""
