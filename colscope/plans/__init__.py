from .modelling import model_report
from .profile import Profile, profile, reprofile

__all__ = ["Profile", "model_report", "profile", "reprofile"]
