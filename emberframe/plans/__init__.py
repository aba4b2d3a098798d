from .decisions import Decision, Reason, choose_join, choose_reduce

__all__ = ["Decision", "Reason", "choose_join", "choose_reduce"]
