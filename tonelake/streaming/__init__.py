"""Left empty on purpose: every operator of this library works on bounded captures."""
