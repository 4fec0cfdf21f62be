"""Readers of raw storage images and replay files, and the exports of what they hold."""
