"""Fixed dimensions: topic rules and stopwords. Venues are data (the ``venues`` table)."""

from __future__ import annotations

from collections.abc import Mapping

OTHER = "other"

# The topic rules, in order. Each is (id, Chinese name, English name, pattern); the patterns define what a
# label means, so they must equal those of the system whose reports are reproduced.
TOPIC_RULES = [
    ("graph", "图算法", "Graph Algorithms", r"\bgraph|\bplanar\b|spanning tree|shortest path|\bmax(imum)?[- ]flow|\bmin(imum)?[- ]cut|\bmatching\b|connectivity|\bminor(s)?\b|treewidth|\bcut(s)? in|vertex cover|independent set|\bcolou?ring\b|\bclique|hamiltonian|\bst-connect|expander decomposition|\bdigraph|\bnetwork(s)?\b|\bsteiner\b|\btsp\b|traveling salesman|\bflow(s)? in|\btree(s)?\b|\bspanner(s)?\b|\brouting\b|\bshortest[- ]path|\bdominating set|\bgirth\b|\bsubgraph"),
    ("approx", "近似算法", "Approximation", r"approximat|\bptas\b|\bfptas\b|inapproxim|approximability|\bhardness of approx|integrality gap|\blp relaxation|rounding"),
    ("complexity", "复杂性理论", "Complexity Theory", r"complexity class|\bnp-(complete|hard)|\bpspace|\bp vs np|\bpcp\b|probabilistically checkable|circuit lower bound|circuit complexity|\bproof complexity|time hierarchy|space hierarchy|derandomiz|\bbpp\b|\bcomplexity of\b|\bcomputational complexity|natural proofs|\bsat\b|satisfiability|\bcsp\b|constraint satisfaction|dichotomy|\bunique games|\bboolean function|\bdecision tree complexity|query complexity|\bformula size"),
    ("crypto", "密码学", "Cryptography", r"cryptograph|encrypt|\bzero[- ]knowledge|secure (multi[- ]?party )?computation|obfuscat|\bsignature(s)?\b|commitment scheme|\bsecret sharing|homomorphic|\boblivious transfer|pseudorandom function|\bone[- ]way function|\bprotocol(s)? for|\bauthenticat|\blattice[- ]based|\blwe\b|\bmpc\b|\bprivacy amplification|\bsnark|verifiable"),
    ("quantum", "量子计算", "Quantum Computing", r"\bquantum|\bqubit|entangle|\bqma\b|\bqip\b"),
    ("game", "博弈论与机制设计", "Game Theory & Mechanism Design", r"\bauction|mechanism design|\bequilibri|\bnash\b|\bgame(s)?\b|incentive|price of anarchy|\bbidder|\bbidding|\brevenue\b|\bstrategyproof|strategy[- ]proof|truthful|\bpricing\b|\bmarket(s)?\b|\bmatching market|\bvoting\b|social choice|\bcontract(s)?\b|\bfair (division|allocation)|envy[- ]free|\bcake cutting|\bstable matching|\bcombinatorial auction"),
    ("learning", "学习理论", "Learning Theory", r"\blearning\b|\blearnab|\bpac\b|\bregret\b|\bbandit|\bboosting\b|sample complexity|neural network|\bdeep learning|\bclassifier|\bclustering\b|\bk-means|mixture model|\bregression\b|\bestimation of|distribution learning|\btesting distributions"),
    ("ds", "数据结构", "Data Structures", r"data structure|\bdictionar|\bhash(ing|ed)?\b|priority queue|\bsuccinct|\boracle(s)?\b|\bindex(ing)?\b|\bself[- ]adjust|\bunion[- ]find|\bpredecessor\b|\bheap(s)?\b|\bfully dynamic|\bdynamic (graph|maintain|algorithm)"),
    ("online", "在线算法", "Online Algorithms", r"\bonline\b|competitive (ratio|analysis)|\bk-server|\bcaching\b|\bpaging\b|\bprophet\b|\bsecretary problem|\bmetrical task"),
    ("random", "随机化与伪随机", "Randomness & Pseudorandomness", r"\brandom(ized|ness|ly)?\b|pseudorandom|\bexpander|\bextractor|\bsampling\b|markov chain|\bmixing time|\bmonte carlo|\bderandom|\bprobabilistic method|\brandom walk|\bmcmc\b"),
    ("sublinear", "流算法与亚线性", "Streaming & Sublinear", r"\bstreaming\b|\bsketch(ing|es)?\b|sublinear|property testing|\bproperty tester|sparse recovery|compressed sensing|\bdata stream|\bsample-based"),
    ("distributed", "分布式与并行", "Distributed & Parallel", r"\bdistributed\b|\bparallel\b|\bpram\b|\blocal model|\bcongest\b|self[- ]stabiliz|\bconsensus\b|fault[- ]toleran|\bbyzantine|\bsynchronous|\basynchronous|\bmapreduce|\bmassively parallel|\bshared memory|\bblockchain|\bledger"),
    ("geometry", "计算几何", "Computational Geometry", r"\bgeometr|convex hull|\bvoronoi|\btriangulat|nearest neighbor|\bpoint set|\barrangement(s)?\b|\bpolygon|\bembedding(s)? into|\bmetric space|\bdoubling dimension|\bdimension reduction"),
    ("coding", "编码与信息论", "Coding & Information Theory", r"\bcode(s)?\b|\bcoding\b|\bdecod|list[- ]decod|error[- ]correct|\bentropy\b|information theoretic|communication complexity|\binformation complexity"),
    ("opt", "优化与线性规划", "Optimization & LP/SDP", r"linear program|semidefinite|\bsdp\b|convex optimization|\bgradient|submodular|\bmatroid|integer program|\bsimplex method|interior point|\bconvex body|\bpolytope|\bfirst[- ]order method|\blocal search|\bheuristic(s)?\b|\bsimulated annealing"),
    ("privacy", "差分隐私", "Differential Privacy", r"differential(ly)? privat|\bprivacy\b|\bprivate (data|learning|algorithm|query|estimation)"),
    ("finegrained", "细粒度复杂性", "Fine-Grained Complexity", r"fine[- ]grained|\bseth\b|\b3sum\b|conditional lower bound|orthogonal vectors|\bapsp\b|\ball[- ]pairs shortest"),
    ("algebraic", "代数与计数", "Algebraic & Counting", r"matrix multiplication|polynomial identity|\balgebraic\b|\bcounting\b|\bpermanent\b|\b#p\b|\btensor\b|\barithmetic circuit|\bdeterminant|\bpartition function|\bholant|\bmatri(x|ces)\b|\beigenvalue|\bspectral\b|\bpolynomial(s)?\b(?!\s+time)|\bfourier\b"),
    ("strings", "字符串算法", "String Algorithms", r"\bstring(s)?\b|pattern matching|edit distance|\bsuffix (tree|array)|\btext index|longest common subsequence|\blcs\b|\bcompression\b"),
    ("scheduling", "调度与装箱", "Scheduling & Packing", r"\bscheduling\b|bin packing|load balanc|\bjob(s)?\b|\bmakespan|\bknapsack|\bbin[- ]covering|\bpacking\b|\bcovering\b|\ballocation of|\bresource allocation"),
    ("logic", "逻辑与形式语言", "Logic, Automata & Formal Languages", r"\bautomat(a|on|ic)\b|\blogic(s)?\b|model checking|\btemporal\b|\bverification\b|\bfirst[- ]order logic|\bdefinability|\bdescriptive complexity|\bgrammar(s)?\b|\b(formal |regular |context[- ](free|sensitive) )?language(s)?\b|\bturing machine|\bcomputab(le|ility)|\bdecidab|\brecursive(ly)? (function|enumerable|defined)|\brewriting\b|\bsemantics\b|\bprogram(ming)? language|\btype system|\blambda calculus"),
    ("circuits", "电路与布尔函数", "Circuits & Boolean Functions", r"\bcircuit(s|ry)?\b|\bboolean\b|\bthreshold (function|logic|organ|gate)|\bswitching (theory|function|network|circuit)|\blogic design|\bgate(s)?\b|\badder\b|\bfault detection|\bsequential machine|\bfinite[- ]state|\bbranching program|\bformula(s|e)? for"),
    ("sorting", "排序与选择", "Sorting & Searching", r"\bsort(ing|ed)?\b|\bselection\b|\bmedian\b|\bsearching\b|\bpermutation(s)?\b|\bmerging\b|\bcomparison(s)? (model|based)|\bbinary search"),
    ("ecommerce", "电子商务与网络经济", "E-Commerce & Internet Economics", r"e-?commerce|e-?business|\brecommender|\breputation\b|\badvertis|information goods|\bconsumer(s)?\b|\bshopping\b|\bcatalog|\bweb (site|server|search)|\binternet\b|\bonline (market|store|retail)|\bsupply chain|\bbusiness model|\bcrowdsourc|\bsponsored search"),
]
OTHER_NAMES = ("其他/未分类", "Other / Unclassified")

# Words that carry no topic in a title.
STOPWORDS = """
a an the of on in for with and or to from via by is are was new some all its their our we you it
using use based towards toward at as be that this these those can how what when where which more
most better fast faster simple simpler general improved optimal near tight lower upper bounds bound
problem problems algorithm algorithms complexity time space efficient hard hardness extended abstract
preliminary version note remarks notes case study results result approach method methods framework
applications application analysis theory model models general first second one two three number
over under between within without into about after before during through while than then also
""".split()

# Titles that begin like this are front matter.
FRONT_MATTER = (
    "front matter|frontmatter|preface|table of contents|conference organization|"
    "author index|title page|foreword|editorial|proceedings of|invited talk abstract"
)


def topic_rules(rules: list[tuple[str, str, str, str]] | None = None) -> list[tuple[str, str, str, str]]:
    """The rules in use; pass your own list of the same shape to change what is labelled."""
    return TOPIC_RULES if rules is None else rules


def topic_ids(rules=None) -> list[str]:
    """Ids in rule order, the fallback last."""
    return [r[0] for r in topic_rules(rules)] + [OTHER]


def select_venues(names: list[str], known: Mapping[str, object]) -> list[str]:
    """Venue slugs, trimmed and in lower case; an unknown one is an error that names those known."""
    chosen = [n.strip().lower() for n in names]
    if unknown := [n for n in chosen if n not in known]:
        raise ValueError(f"unknown venues {unknown}; known: {sorted(known)}")
    return chosen
