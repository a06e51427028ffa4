from codeq.plans import corpus, platform, streams  # noqa: F401
from codeq.plans.registry import REGISTRY  # noqa: F401
