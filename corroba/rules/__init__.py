"""Rules, the labels they give, and the passes that apply them."""
