"""Topic models fitted by Spark jobs; each gives phi and theta as long tables."""

from .base import Corpus, TopicModel
from .clusters import BERTopic, Top2Vec
from .derived import CSATM, GDMR, HDP, AuthorRecipientTopic, DiscLDA, EmbeddingLDA, GuidedNMF, SemanticSignals, SupervisedLDA, ThreadTM, TopicGPT, Wordshoal
from .embedded import DETM, ETM, GaussianLDA, IdealPointSentenceTM
from .factor import LSA, NMF, KeyNMF
from .gibbs import WarpLDA
from .guided import AnchorLDA, AuthorTopic, KeyATM, TopicsOverTime
from .logistic import CTM, STM, OnlineSTM, TreeFieldTM
from .mixture import BTM, GSDMM
from .moments import TensorLDA
from .neural import CombinedTM, ProdLDA, Scholar, ZeroShotTM
from .phrases import TopicalNGrams
from .positions import TBIP
from .scaling import Wordfish
from .structured import DTM, HLDA, MGLDA, PA, PT, RTM, SAGE, CorEx, FactorialLDA, NarrativeTM
from .variational import DMR, LDA, LabeledLDA, OnlineLDA, PolylingualLDA, SeededLDA

__all__ = [
    "AnchorLDA", "AuthorRecipientTopic", "AuthorTopic", "BERTopic", "BTM", "CSATM", "CTM", "CombinedTM", "CorEx",
    "Corpus", "DETM", "DMR", "DTM", "DiscLDA", "ETM", "EmbeddingLDA", "FactorialLDA", "GDMR", "GSDMM", "GaussianLDA",
    "GuidedNMF", "HDP", "HLDA", "IdealPointSentenceTM", "KeyATM", "KeyNMF", "LDA", "LSA", "LabeledLDA", "MGLDA", "NMF",
    "NarrativeTM", "OnlineLDA", "OnlineSTM", "PA", "PT", "PolylingualLDA", "ProdLDA", "RTM", "SAGE", "STM", "Scholar",
    "SeededLDA", "SemanticSignals", "SupervisedLDA", "TBIP", "TensorLDA", "ThreadTM", "Top2Vec", "TopicGPT", "TreeFieldTM", "TopicModel", "TopicalNGrams",
    "TopicsOverTime", "WarpLDA", "Wordfish", "Wordshoal", "ZeroShotTM",
]
