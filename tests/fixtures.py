"""Hand fixture of FIXTURES.md section 2 (matrices by row)."""
import numpy as np

PI1 = [.6, .4]
A = [[.3, .7], [.6, .4]]
B1 = [[.5, .3, .2], [.1, .3, .6]]
P = [[.1, .2, .2], [.1, .2, .2]]
PI0 = [.5, .5]
B0 = [[.2, .2, .6], [.3, .5, .2]]

SEQS = ["0", "2", "0;1", "0;1;2", "0;0;2;1;2", "2;2;2;2;0;0"]
# obs -> (score m1, score m0, score m1 prefix T=2)
SCORES = {
    "0": (-3.48024059, -4.34280592, -3.48024059),
    "2": (-3.39322921, -3.21887582, -3.39322921),
    "0;1": (-7.20495450, -7.82820710, -7.20495450),
    "0;1;2": (-10.27454503, -10.50863040, -7.20495450),
    "0;0;2;1;2": (-16.59705578, -17.01230210, -7.48918065),
    "2;2;2;2;0;0": (-20.33421908, -21.69398853, -6.69933631),
}
# obs -> (newPi, newA, newB, newP) under m1
ESTIMATES = {
    "0": ([.974025974, .025974026], [[.68181818, .31818182], [.88235294, .11764706]],
          [[1, 0, 0], [1, 0, 0]], [[.01795332, .48204668, 0], [.46218044, .03781956, 0]]),
    "0;1": ([.7513589339, .2486410661], [[.3, .7], [.6, .4]],
            [[.75748248, .24251752, 0], [.24664715, .75335285, 0]],
            [[.2066237, .24465266, .04872364], [.30771001, .18547509, .0068149]]),
    "0;1;2": ([.586595905, .413404095], [[.14295514, .85704486], [.34188592, .65811408]],
              [[.79594423, .03181652, .17223925], [.18267815, .43152616, .38579569]],
              [[.2616883, .20544055, .03287115], [.2345887, .18940023, .07601107]]),
    "0;0;2;1;2": ([.5191427292, .4808572708], [[.27552711, .72447289], [.45183406, .54816594]],
                  [[.68435131, .26598873, -.04965996], [.30044892, .18268671, .51686437]],
                  [[.23574592, .18076462, .08348946], [.25359474, .20337537, .04302989]]),
    "2;2;2;2;0;0": ([.653309762, .346690238], [[.46248608, .53751392], [.59897216, .40102784]],
                    [[.36629756, 0, .63370244], [-.09017315, 0, .90982685]],
                    [[.24767656, .15896913, .09335431], [.25331631, .1758662, .07081749]]),
}
# three EM iterations on the six sequences from m1, flat column-major
EM_TRACE = [
    (-61.28424419, [.60454841, .39545159], [.33129775, .53472974, .66870225, .46527026],
     [.61078986, .28173516, .09156958, .23499091, .29764056, .48327393],
     [.22638147, .27300305, .23054543, .19421806, .04307309, .03277889]),
    (-60.96212723, [.68183591, .31816409], [.29434253, .45386198, .70565747, .54613802],
     [.55467939, .31572166, .04329608, .27139047, .40202453, .41288787],
     [.22503309, .28206726, .2451438, .18428593, .02982311, .03364681]),
    (-59.76715979, [.78019631, .21980369], [.28620776, .41435464, .71379224, .58564536],
     [.5354296, .34007984, .02719407, .30936285, .43737632, .3505573],
     [.18283223, .30009207, .29060967, .16694574, .0265581, .03296219]),
]


def parse(s):
    return [int(x) for x in s.split(";")]


def col_major(mat):
    return np.asarray(mat).T.reshape(-1).tolist()
