"""From program text to typed rules, and from those to DataFrame plans."""
