"""The scorer of extensions with mates: a polynomial kernel over (first votes, second votes, read density, bare tail)."""

from __future__ import annotations

from .votes import KernelModel

# They decide results and must stay as they are. Support vectors, their weights, bias, factor and shift a feature.
VECTORS = (
    (-1.0745090554491239, 0.45420824248867225, -0.28051850889741825, 8.3521201056709504),
    (-1.449842078413667, -0.12131027594417958, 0.35997709504856301, 1.4924005629430226),
    (-1.5999752875994842, -0.12131027594417958, -0.39618082184300307, 1.1216049119847562),
    (-0.023576591148403107, 3.3318008346529315, -0.35354033780776434, -1.1031689937648421),
    (4.5554862890190222, 12.827856388794986, 3.0253626846179404, -1.8447602956813749),
    (0.27668982722323138, 4.1950786123022095, 0.2894426277069389, 0.75080926102648982),
    (1.7780219190814037, 4.1950786123022095, 3.2991501258608689, -0.17617986636917615),
    (0.27668982722323138, 2.7562823162200796, 3.7710381491841773, 0.75080926102648982),
    (-1.1495756600420324, 1.0297267609215242, 3.0266063654023019, -0.91777116828570893),
    (-1.6750418921923929, -0.12131027594417958, 0.37987599758834085, 0.75080926102648982),
    (-1.2997088692278496, 1.3174860201379499, 0.47279670905846516, 2.4193896903386887),
    (-0.8493092416703979, 2.7562823162200796, -0.36437812750005416, -1.2885668192439754),
    (-1.7501084967853013, -0.12131027594417958, -0.46191823473066274, 7.6105288037544181),
    (-1.7501084967853013, -0.12131027594417958, -0.24907115192142965, 1.1216049119847562),
    (-1.5999752875994842, 0.45420824248867225, -0.96170024136035603, 2.9755831667760884),
    (-1.7501084967853013, -0.12131027594417958, -1.7134164411649178, 0.19461578458909023),
)
ALPHA = (
    -0.0014146167152327112, -0.11641250192930988, -0.51000000000000001, -0.0086375276376673346,
    0.0000013349739772193858, 0.00062364957627172378, 0.00029779884869670753, 0.00038888245537085388,
    0.0010017833091020406, 0.1248262622127996, 0.0041971265671833921, 0.014376019655337762,
    0.0021102580260678261, 0.45178948751608006, 0.01037221652719398, 0.02647982661412868,
)
BIAS = -5.3947654205082323
FACTOR = (0.07506660459290862, 0.28775925921642592, 1.7766868348016116, 0.18539782547913319)
SHIFT = (-24.314075630252102, -1.4215686274509804, -1.0706885504201653, -9.9502801120448172)

#: With mates. The single-end model is a table of its own (KernelModel.from_rows) or is fitted (votes.fit_kernel).
PAIRED = KernelModel(VECTORS, ALPHA, BIAS, SHIFT, FACTOR)
