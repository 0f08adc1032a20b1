from . import annotation, geometry, identity, policy, scores, sequences

__all__ = ["annotation", "geometry", "identity", "policy", "scores", "sequences"]
